"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.session import cut


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step: every node moves its links to the smallest node it can see."""
    both = edges.union(edges.select("b", "a")).toDF("a", "b")
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("least"))
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
    low = large.groupBy("a").agg(F.min("b").alias("least"))
    small = large.join(low, "a").select(F.col("b").alias("x"), F.col("least").alias("y")).where("x <> y")
    return small.union(low.select("a", "least")).toDF("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes in ``edges`` (a, b) but the roots themselves; a root is the smallest node it reaches.

    Links are exchanged between stars until nothing changes, in rounds that grow with the logarithm of the longest path.
    Each round is a table in the shared folder; the driver only sees its number of rows and a checksum.
    """
    links = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return links.toDF("node", "root")
        seen, links = state, cut(_stars(links))
