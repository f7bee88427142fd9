"""Near-duplicate texts by the exact similarity of their word shingles.

Two texts are linked if the sets of their shingles have a Jaccard similarity of ``SIMILAR`` or more. Pairs are only
proposed by hashes, and every proposed pair is settled on the shingles themselves, so no link is wrong.

A 64-bit SimHash cannot propose them all: at similarity 0.8 two fingerprints differ in about ten bits, and a budget that
takes in the spread around that meets unrelated texts too. So pairs are proposed twice: by SimHashes within three bits
(``pigeonring.links``), and by MinHashes in 32 bands of five. A pair of similarity 0.8 shares no band with a chance of
(1 - 0.8^5)^32, three in a million; more similar pairs are missed less.

In a band's bucket every text is first settled against one host. Whatever is then still in different groups of one bucket of
up to ``FEW`` texts is settled pair by pair, but for pairs whose numbers of shingles are too far apart to reach the similarity.
A bucket of copies so costs one pair per text.

Texts of larger buckets meet by what sets them apart (``crowded``). Let P be a pivot's shingles, n their number, and let a
text x lack L(x) of them and have N(x) others; these marks are its difference from P. Counting shows that x and y are
similar if and only if they share (v(x) + v(y) - n) / 9 marks or more, with v = 5 L + 4 N, and that x and P are similar if
and only if v(x) <= n. Texts similar to the pivot are linked through it, so one of two texts still to be compared has
v > n, and the two must share a mark. Marks are taken rarest first: two lists that share k marks share one
that has k - 1 or more behind it in both. What such lists cannot rule out is settled on the texts; no text is left out.

Defined results: texts are lower-cased bytes cut at ASCII white space; shorter texts are one shingle; NULL and wordless
texts are similar to each other and to nothing else; repeated shingles count once; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm import pigeonring, worker
from sightline.llm.graph import components
from sightline.session import cut

SIMILAR = (4, 5)  # at least 4/5, in whole numbers
BANDS, ROWS = 32, 5
FEW = 16
_CHUNK = 256
_RANDOM = np.random.default_rng(42)
_TIMES = _RANDOM.integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64)


def shingles(text: str | None, words: int = 5) -> set[bytes]:
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def similar(a: set[bytes], b: set[bytes]) -> bool:
    both = len(a & b)
    return SIMILAR[1] * both >= SIMILAR[0] * (len(a) + len(b) - both)


def bands(found: set[bytes]) -> np.ndarray:
    """One key per band; texts that share all minima of a band share its key."""
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, 7) for s in found), np.uint64, len(found))
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for a in range(0, len(hashes), _CHUNK):
        np.minimum(least, (hashes[a : a + _CHUNK, None] * _TIMES + _PLUS).min(0), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(rows[i].tobytes(), i) for i in range(BANDS)], np.uint64).astype(np.int64)


def sketches(texts: DataFrame, words: int) -> DataFrame:
    """(id, fp, size, bands) of every row of ``texts`` (id, text)."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.let_go()
        for b in batches:
            fps, sizes, keys = [], [], []
            for t in b.column(1):
                text = t.as_py()
                found = shingles(text, words)
                fps.append(pigeonring.fingerprint(text, words))
                sizes.append(len(found))
                keys.append(bands(found))
            fp = pa.array(np.array(fps, np.uint64).astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), fp, pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["id", "fp", "size", "bands"])

    return texts.select("id", "text").mapInArrow(of, "id long, fp long, size long, bands array<long>")


def settled(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose texts are similar."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, set()
        for batch in batches:
            keep = []
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if a != last:
                    last, held = a, shingles(x.as_py(), words)
                keep.append(similar(held, shingles(y.as_py(), words)))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left, right = (texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    return pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(of, "a long, b long")


def _could(x: str, y: str):
    """The numbers of shingles allow for the similarity."""
    return SIMILAR[1] * F.least(x, y) >= SIMILAR[0] * F.greatest(x, y)


def marks(members: DataFrame, words: int) -> DataFrame:
    """(main, id, root, n, lost, new, marks) of ``members`` (main, id, root, text, pivot_text): the differences from the pivot.

    ``n`` counts the pivot's shingles, ``lost`` those that the text lacks, ``new`` its others; ``marks`` are hashes of both.
    """
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, set()
        for batch in batches:
            sizes, found = [], []
            for main, x, y in zip(batch.column(0).to_pylist(), batch.column(3), batch.column(4), strict=True):
                if main != last:
                    last, held = main, shingles(y.as_py(), words)
                own = shingles(x.as_py(), words)
                lost, new = held - own, own - held
                sizes.append((len(held), len(lost), len(new)))
                found.append(np.array([xxhash.xxh64_intdigest(s, 11) for part in (lost, new) for s in part], np.uint64).astype(np.int64))
            counts = [pa.array(c, pa.int64()) for c in np.array(sizes, np.int64).reshape(-1, 3).T]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *counts, pa.array(found, pa.list_(pa.int64()))], ["main", "id", "root", "n", "lost", "new", "marks"])

    return members.select("main", "id", "root", "text", "pivot_text").mapInArrow(of, "main long, id long, root long, n long, lost long, new long, marks array<long>")


def crowded(members: DataFrame, texts: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) to pivots, and the pairs (a, b) of texts that may be similar besides, within each ``main`` of ``members`` (main, id, root, met)."""
    members = cut(members.join(members.groupBy("main").agg(F.max_by("id", F.struct("met", "id")).alias("pivot")), "main"))
    own = members.join(texts.select("id", "text"), "id")
    pivots = members.where("id = pivot").select("main", "id").join(texts.select("id", F.col("text").alias("pivot_text")), "id").drop("id")
    told = cut(marks(own.join(pivots, "main"), words))
    links = told.where("5 * lost + 4 * new <= n").join(members.select("main", "id", "pivot"), ["main", "id"]).select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).where("a <> b")

    # Where texts have more marks than shingles, nothing at all is the better pivot.
    loose = cut(told.groupBy("main").agg(F.sum("n").alias("n"), F.sum("lost").alias("lost")).where("2 * lost > n").select("main"))
    bare = marks(own.join(loose, "main", "left_semi").withColumn("pivot_text", F.lit(None).cast("string")), words)
    chosen = cut(told.join(loose, "main", "left_anti").union(bare))

    often = chosen.select("main", "id", F.explode("marks").alias("mark")).withColumn("often", F.count(F.lit(1)).over(Window.partitionBy("main", "mark")))
    lists = often.groupBy("main", "id").agg(F.sort_array(F.collect_list(F.struct("often", "mark"))).alias("list"))
    sized = chosen.select("main", "id", "root", "n", (5 * F.col("lost") + 4 * F.col("new")).alias("v"), (F.col("lost") + F.col("new")).alias("size"))
    placed = sized.join(lists, ["main", "id"]).select("main", "id", "root", "n", "v", "size", F.posexplode("list").alias("at", "one")).where("one.often > 1")
    left = F.col("size") - F.col("at")  # marks from this one on
    probes, kept = 5 * left >= F.col("v") - F.col("n"), (9 * left > F.col("v")) & (5 * left >= F.col("v") - F.col("n"))
    placed = cut(placed.select("main", "id", "root", "n", "v", left.alias("left"), F.col("one.mark").alias("mark"), (probes & (F.col("v") > F.col("n"))).alias("probes"), kept.alias("kept")).where("probes or kept"))
    x = placed.where("probes").select("main", "mark", "n", *[F.col(c).alias(f"{c}_x") for c in ("id", "root", "v", "left")])
    y = placed.where("kept").select("main", "mark", "id", "root", "v", "left", (F.col("v") > F.col("n")).alias("far"))
    once = (F.col("root_x") != F.col("root")) & (~F.col("far") | (F.col("id_x") < F.col("id")))
    pairs = x.join(y, ["main", "mark"]).where(once & (9 * F.least("left_x", "left") >= F.col("v_x") + F.col("v") - F.col("n")))
    return links, pairs.select(F.least("id_x", "id").alias("a"), F.greatest("id_x", "id").alias("b"))


def groups(texts: DataFrame, words: int = 5) -> DataFrame:
    """(id, root) of every row of the stored table ``texts`` (id, text), whose ids are unique; roots are their group's smallest id."""
    drawn = cut(sketches(texts, words))
    in_bucket = Window.partitionBy("key")
    placed = drawn.select("id", "size", F.explode("bands").alias("key")).withColumns({"host": F.min("id").over(in_bucket), "n": F.count(F.lit(1)).over(in_bucket)})
    buckets = cut(placed.where("n > 1"))
    prints = cut(drawn.groupBy("fp").agg(F.min("id").alias("host")))
    ends = [prints.select(F.col("fp").alias(c), F.col("host").alias(f"host_{c}")) for c in "ab"]
    near = pigeonring.links(prints.select("fp")).join(ends[0], "a").join(ends[1], "b").select(F.col("host_a").alias("a"), F.col("host_b").alias("b"))
    alike = drawn.join(prints, "fp").select(F.col("host").alias("a"), F.col("id").alias("b"))
    hosted = buckets.select(F.col("host").alias("a"), F.col("id").alias("b"))
    proposed = near.union(alike).union(hosted).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    first = cut(proposed.distinct())
    linked = cut(settled(first, texts, words))
    rooted = cut(buckets.drop("host").join(components(linked).withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id")))
    mixed = cut(rooted.groupBy("key").agg(F.mode("root").alias("main"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key", "main"))
    rest = rooted.join(mixed, "key")
    few = rest.where(F.col("n") <= FEW)
    one = few.where("root <> main").select("key", F.col("id").alias("x"), F.col("root").alias("root_x"), F.col("size").alias("size_x"))
    pairs = one.join(few, "key").where((F.col("root_x") != F.col("root")) & _could("size_x", "size"))
    many = rest.where(F.col("n") > FEW).groupBy("main", "id").agg(F.first("root").alias("root"), F.sum("n").alias("met"))
    pivoted, close = crowded(many, texts, words)
    second = pairs.select(F.least("x", "id").alias("a"), F.greatest("x", "id").alias("b")).union(close).distinct().join(first, ["a", "b"], "left_anti")
    linked = linked.union(pivoted)
    found = components(linked.union(settled(cut(second), texts, words))).withColumnRenamed("node", "id")
    return drawn.select("id").join(found, "id", "left").select("id", F.coalesce("root", "id").alias("root"))
