"""Classifier outputs: top classes per row and accuracy per epoch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.arrays import argmax, cross_entropy, max_prob, softmax, top_k


def with_prediction(df: DataFrame, logits: str = "logits") -> DataFrame:
    x = F.col(logits)
    return df.withColumns({"predicted": argmax(x), "confidence": max_prob(x)})


def top_predictions(df: DataFrame, names: Column, k: int = 5, logits: str = "logits") -> DataFrame:
    """Add ``top``: the k most probable classes as (name, confidence)."""
    ranked = top_k(softmax(F.col(logits)), k)
    return df.withColumn("top", F.transform(
        ranked, lambda r: F.struct(F.element_at(names, r["position"] + 1).alias("name"), r["value"].alias("confidence"))))


def classification_metrics(predictions: DataFrame) -> DataFrame:
    """Accuracy in percent and mean loss per epoch; ``best`` marks the first best accuracy."""
    x = F.col("logits")
    per = predictions.groupBy("epoch").agg(
        F.count(F.lit(1)).alias("n"), (F.avg((argmax(x) == F.col("label")).cast("double")) * 100).alias("accuracy"),
        F.avg(cross_entropy(x, F.col("label"))).alias("loss"),
    )
    best = per.agg(F.max_by("epoch", F.struct(F.col("accuracy"), -F.col("epoch")))).scalar()
    return per.withColumn("best", F.col("epoch") == best)
