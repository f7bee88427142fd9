"""Mixing sources to target weights by capped water-filling.

Every source is given a share of all words in proportion to its weight. A source stops at ``cap`` times its own size;
what it cannot take is dealt out again among the others in proportion to their weights, until no source is above its
cap. A source then takes each of its documents a whole number of times, and a seeded choice of them once more for the
fraction that is left.

Only DataFrame expressions are used. One row per source is all that the rounds of water-filling read, and only single
figures reach the driver. The seeded choice needs running totals in the order of a seeded draw: totals of 4,096 slices
of the draw are added up per source, and documents are put in order only within their slice, so a source that holds
most rows is spread over as many groups as any other rows.

Defined results: a NULL text has size 0; a NULL source is a source of its own, last in order; documents of size 0 are
taken as often as others of their source but add nothing; an empty table gives an empty result; columns beyond the
named ones are not read. Rows that repeat a document id are separate rows with the same draw.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.session import cut

_ONE_WORD = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"
_SLICES = 4096
_DRAW_BITS = 60


def word_count(text: Column) -> Column:
    """Number of words; NULL counts as empty. Words become letters to be counted, so no list of them is made."""
    letters = F.when(F.rlike(text, F.lit(r"[^\x20\x09-\x0D]")), F.regexp_replace(text, _ONE_WORD, "x")).otherwise("")
    return F.length(letters).cast("long")


def source_key(source: Column) -> Column:
    """A key without NULL that keeps the order of sources by code point, NULL last."""
    return F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source))


def draw(doc_id: Column, seed: int) -> Column:
    """A seeded number of 60 bits for a document id, the same on every run and any number of partitions."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, _DRAW_BITS // 4), 16, 10).cast("long")


def cycled_weights(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Adds ``weight``: the numbers of ``cycle``, repeating over the sources in the order of their key.

    ``sizes`` has one row per source, so this order is of sources and not of documents.
    """
    rank = F.row_number().over(Window.orderBy("source_key")) - 1
    return sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (rank % len(cycle) + 1).cast("int")))


def water_fill(sizes: DataFrame, cap: float = 3.0) -> DataFrame:
    """Adds ``target`` to rows of (source_key, source_size, weight).

    One level fits all sources: a source takes ``level * weight``, or its cap where that is more. Each round takes the
    sources above their cap out and raises the level for the rest; the level only rises, so a source that is out stays out.
    """
    most = F.lit(cap) * F.col("source_size")
    total, weights = sizes.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    level, out = (total / weights if weights else 0.0), -1
    while True:
        above = F.lit(level) * F.col("weight") > most
        n, held, weights = sizes.agg(
            F.count_if(above),
            F.coalesce(F.sum(F.when(above, most)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)),
        ).first()
        if n == out or not weights:
            return sizes.withColumn("target", F.when(above, most).otherwise(F.lit(level) * F.col("weight")))
        level, out = (total - held) / weights, n


def repeats(sized: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """Adds ``source_size``, ``target`` and ``copies`` to rows of (doc_id, source_key, size, ...).

    All documents of a source get the whole part of its rate. For the rest, they are put in the order of their draw and
    taken while the middle of the document lies within the words that are missing, so the source ends half a document
    from its target at most.
    """
    slices = Window.partitionBy("source_key").orderBy("slice")
    within = Window.partitionBy("source_key", "slice").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = sized.withColumn("draw", draw(F.col("doc_id"), seed)).withColumn("slice", F.shiftright("draw", _DRAW_BITS - 12))
    totals = (
        rows.groupBy("source_key", "slice")
        .agg(F.sum("size").alias("words"))
        .withColumn("before", F.sum("words").over(slices) - F.col("words"))
        .drop("words")
        .join(targets.select("source_key", "source_size", "target"), "source_key")
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("missing", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    before = F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0))
    return (
        rows.join(totals, ["source_key", "slice"])
        .withColumn("before", before)
        .withColumn("copies", F.col("whole") + F.when((F.col("missing") > 0) & (2 * F.col("before") + F.col("size") <= 2 * F.col("missing")), 1).otherwise(0))
        .drop("draw", "slice", "before", "whole", "missing")
    )


def mix(docs: DataFrame, cap: float = 3.0, cycle: tuple[int, ...] = (1, 2, 3), seed: int = 7, weights: DataFrame | None = None) -> DataFrame:
    """Rows (doc_id, source_key, size, source_size, target, copies) of every document in ``docs`` (doc_id, text, source).

    ``weights`` (source, weight) overrides the cycle; sources that it doesn't name weigh nothing.
    """
    sized = cut(docs.select("doc_id", source_key(F.col("source")).alias("source_key"), word_count(F.col("text")).alias("size")))
    sizes = sized.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    if weights is None:
        sizes = cycled_weights(sizes, cycle)
    else:
        given = weights.select(source_key(F.col("source")).alias("source_key"), F.col("weight").cast("double").alias("weight"))
        sizes = sizes.join(given, "source_key", "left").fillna(0.0, "weight")
    return repeats(sized, water_fill(cut(sizes), cap), seed)
