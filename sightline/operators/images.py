"""Names of the augmented versions of an image inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.operators.curation import cap_per_class, file_counter


def augmented_manifest(inventory: DataFrame, factor: int = 8, cap: int = 300, seed: int = 42) -> DataFrame:
    """File name of each version beside its original (path, class_name); number 0 is the original, which isn't written again.

    A class keeps as many originals as give ``cap`` versions at most. Names need no pixels: one row per version.
    """
    kept = file_counter(cap_per_class(inventory.select("path", "class_name"), factor, cap, seed))
    base = F.regexp_replace("path", r"\.[^./]+$", "")
    name = F.concat(base, F.lit("_aug"), F.col("variant").cast("string"), F.lit("_"), F.col("counter").cast("string"), F.lit(".jpg"))
    return kept.withColumn("variant", F.explode(F.sequence(F.lit(1), F.lit(factor - 1)))).withColumn("out_path", name)
