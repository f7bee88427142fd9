"""Row numbers and neighbours without pulling a group into one task.

A window over a hot group runs in a single task. These helpers sort by range instead, so a
group of any size is spread over many tasks, and number the rows from the partition sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.session import cut

_LOW_BITS = (1 << 33) - 1
BUCKET = 4096


def dense_position(df: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """Add the zero-based position of each row in the global order.

    ``order`` must identify rows uniquely. The sorted rows are checkpointed so that a lost
    executor cannot renumber them; only one count per partition is combined in one place.
    """
    placed = cut(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_mid", 33))
    # one row per partition of the sort: its size is bounded by the partition count, not the data
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_mid").bitwiseAND(F.lit(_LOW_BITS)))
        .drop("_part", "_mid", "_offset")
    )


def row_index(df: DataFrame, by: list[str], order: list[Column], name: str = "idx") -> DataFrame:
    """Zero-based position of each row inside its group."""
    placed = dense_position(df, [*[F.col(b) for b in by], *order], "_pos")
    if not by:
        return placed.withColumnRenamed("_pos", name)
    # stored, so that its true size decides whether the rows must be shuffled to meet it
    starts = cut(placed.groupBy(*by).agg(F.min("_pos").alias("_start")))
    same = [F.col(f"r.{b}").eqNullSafe(F.col(f"s.{b}")) for b in by]
    joined = placed.alias("r").join(starts.alias("s"), same)
    return joined.select("r.*", (F.col("_pos") - F.col("_start")).alias(name)).drop("_pos")


def following_rows(df: DataFrame, by: str, order: list[Column], columns: list[str], ahead: int) -> DataFrame:
    """Pair every row with each of the next ``ahead`` rows of its group.

    Rows are cut into equal buckets of consecutive positions; the head of a bucket is also sent
    to the bucket before it, so each bucket is a small window and no bucket is larger than the rest.
    """
    placed = dense_position(df.select(by, *columns), [F.col(by), *order], "_pos")
    home = F.floor(F.col("_pos") / BUCKET)
    also = F.when((F.pmod("_pos", F.lit(BUCKET)) < ahead) & (home > 0), F.array(home, home - 1)).otherwise(F.array(home))
    spread = placed.withColumn("_home", home).withColumn("_bucket", F.explode(also))
    row = Window.partitionBy("_bucket").orderBy("_pos")
    nexts = F.array(*[
        F.struct(F.lit(k).alias("step"), *[F.lead(c, k).over(row).alias(f"next_{c}") for c in [by, *columns]])
        for k in range(1, ahead + 1)
    ])
    return (
        spread.select("_bucket", "_home", by, *columns, nexts.alias("_nexts"))
        .where(F.col("_bucket") == F.col("_home"))
        .select(by, *columns, F.inline("_nexts"))
        .where(F.col(f"next_{by}") == F.col(by))
    )
