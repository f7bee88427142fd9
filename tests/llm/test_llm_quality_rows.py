"""The pipeline's quality stage judges rows where they lie: the rows of a join by their keys, and no text is moved."""

from pyspark.sql import functions as F

import corpus_pipeline
from sightline.llm import site_quality


def test_rows_are_judged_where_they_lie(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = docs.limit(40).union(docs.limit(20)).union(docs.limit(5).withColumn("doc_id", F.lit(None).cast("long"))).union(docs.limit(3).withColumn("text", F.lit(None).cast("string")))
    docs = docs.union(odd).withColumn("keep", F.lit(1)).withColumn("evidence", F.lit("mine"))
    kept = corpus_pipeline.quality(spark, docs, sf_dir)
    keyed = docs.withColumn("k", corpus_pipeline._row_key(docs))
    judged = site_quality.score(keyed, spark.read.parquet(f"{sf_dir}/labels.parquet"), host="source", path="lang", key="k")
    want = keyed.join(judged.where("keep").select(F.col("doc_id").alias("k")).distinct(), "k", "left_semi").drop("k")
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert kept.exceptAll(want).count() == 0 and want.exceptAll(kept).count() == 0
    plan = kept._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and "LeftSemi" not in plan
