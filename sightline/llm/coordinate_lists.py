"""Hard negatives by exact search over inner products, pruned by length and by coordinates.

Vectors are sorted by length and cut into buckets. A bucket keeps its vectors, and for every coordinate the order of
its vectors by the value they have there after scaling to length one. An anchor that looks for scores of ``low`` or more
skips a bucket whose longest vector cannot reach it. Elsewhere ``low`` is a least cosine c, and a vector at c or nearer
differs from the anchor in no coordinate by more than the rest of both vectors allows: with q and p their values in one
coordinate, q p + sqrt(1 - q²) sqrt(1 - p²) >= c bounds p from both sides. The bounds for the anchor's largest
coordinates are ranges of the sorted lists; vectors in all of them are multiplied out exactly.

Scores are first sought in the bucket of the longest vectors. The k-th best there is the least score worth looking for
in the others, so pruning starts from a bound that some vectors reach. Anchors meet buckets in slabs of bounded size.

Defined results: rows with a NULL id, label or vector, or with a NULL or non-finite component, take no part. Components are
floor(256 x); missing ones of shorter vectors count as zero. Rows with one id are candidates each, but none of them for
an anchor with that id; of several anchors with one id the one with the smallest label, then vector, is mined. Ties go
to the smaller id. Empty tables give empty results, other columns are ignored. Scores beyond 64 bits are an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.operators.ordinals import dense_position
from sightline.session import cut

#: Vectors of a bucket and anchors of a slab.
BUCKET = 8192
SLAB = 1024
#: Coordinates of an anchor whose lists are intersected.
FOCUS = 6
LEAST, MOST = -(1 << 63), (1 << 63) - 1
_SLACK = 1e-9
_EXACT = 2.0**53


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v): rows that take part, components as whole numbers."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    finite = F.forall(x, lambda e: F.coalesce(F.abs(e) < float("inf"), F.lit(False)) & ~F.isnan(F.coalesce(e, F.lit(0.0))))
    kept = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    return kept.select("vec_id", F.col("label").cast("long").alias("label"), F.transform(x, lambda e: F.floor(e * 256)).alias("v"))


# ---- buckets -------------------------------------------------------------------------------

_BUCKET = "bucket long, n long, dim long, longest double, ids binary, labels binary, vectors binary, orders binary"


def _matrix(lists: list[list[int]], dim: int) -> np.ndarray:
    out = np.zeros((len(lists), dim), np.int64)
    for row, values in zip(out, lists):
        row[:min(dim, len(values))] = values[:dim]
    return out


def _lengths(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m.astype(float) ** 2).sum(axis=1))


def _unit(m: np.ndarray) -> np.ndarray:
    size = _lengths(m)
    return m / np.where(size > 0, size, 1)[:, None]


def _bucket(key: tuple, rows: pa.Table) -> pa.Table:
    lists = rows["v"].to_pylist()
    dim = max(1, max(map(len, lists)))
    m = _matrix(lists, dim)
    orders = np.argsort(_unit(m), axis=0, kind="stable").T.astype(np.int32)
    arrays = {"ids": rows["vec_id"].to_numpy(), "labels": rows["label"].to_numpy(), "vectors": m, "orders": orders}
    return pa.table({"bucket": [key[0].as_py()], "n": [len(m)], "dim": [dim], "longest": [float(_lengths(m).max())], **{k: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for k, v in arrays.items()}})


class Bucket:
    """Vectors of one row of the index, and the lists of their coordinates."""

    def __init__(self, row: dict):
        self.dim, self.longest = row["dim"], row["longest"]
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.m = np.frombuffer(row["vectors"], np.int64).reshape(-1, self.dim)
        self.orders = np.frombuffer(row["orders"], np.int32).reshape(self.dim, -1)
        self.unit, self.real = _unit(self.m), self.m.astype(float)
        self.largest = float(np.abs(self.real).max(initial=0))
        self.listed: dict[int, np.ndarray] = {}

    def values(self, f: int) -> np.ndarray:
        if f not in self.listed:
            self.listed[f] = self.unit[self.orders[f], f]
        return self.listed[f]

    def candidates(self, q: np.ndarray, low: int) -> np.ndarray | None:
        """Rows that may score ``low`` or more, or None if all may."""
        size = math.sqrt(float((q.astype(float) ** 2).sum()))
        if low <= 0:
            return None
        least = low / (size * self.longest) if size * self.longest > 0 else math.inf
        if least > 1 + _SLACK:
            return np.zeros(0, np.int64)
        least = min(1.0, least)
        unit = q / size
        rows = None
        for f in np.argsort(-np.abs(unit), kind="stable")[:FOCUS]:
            if f >= self.dim:  # zero in all vectors here
                continue
            x = float(unit[f])
            apart = math.sqrt(max(0.0, (1 - least * least) * (1 - x * x)))
            lower = x * least - apart if x > -least else -1.0  # beyond it even the axis itself is near enough
            upper = x * least + apart if x < least else 1.0
            if rows is None:
                a, b = np.searchsorted(self.values(f), [lower - _SLACK, upper + _SLACK], side="left")
                rows = self.orders[f, a:b]
            else:
                there = self.unit[rows, f]
                rows = rows[(there >= lower - _SLACK) & (there <= upper + _SLACK)]
        return rows

    def scores(self, q: np.ndarray, rows: np.ndarray | None) -> np.ndarray:
        """Exact inner products."""
        q = q[:self.dim]
        if self.largest * float(np.abs(q.astype(float)).max(initial=0)) * self.dim < _EXACT:
            return ((self.real if rows is None else self.real[rows])[:, :len(q)] @ q.astype(float)).astype(np.int64)
        return ((self.m if rows is None else self.m[rows])[:, :len(q)].astype(object) @ q.astype(object)).astype(np.int64)


_FOUND = "anchor_id long, place int, vec_id long, score long, looked long"


def _search(anchors: list[dict], bucket: Bucket, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """Best ``k`` of the bucket for each anchor and window; ``looked`` counts the vectors multiplied out."""
    for a in anchors:
        q, windows = np.array(a["v"], np.int64), a["windows"]
        rows = bucket.candidates(q, min(w["low"] for w in windows))
        score = bucket.scores(q, rows)
        ids, labels = (bucket.ids, bucket.labels) if rows is None else (bucket.ids[rows], bucket.labels[rows])
        other = ids != a["anchor_id"]
        for w in windows:
            fits = np.flatnonzero(other & ((labels == a["label"]) == w["same"]) & (score >= w["low"]) & (score <= w["high"]))
            best = fits[np.lexsort((ids[fits], -score[fits]))[:k]]
            yield a["anchor_id"], w["place"], ids[best], score[best], len(score)


def index(vectors: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Stored buckets of whole-number vectors, the longest in bucket 0."""
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = vectors.select((-length).alias("_short"), "vec_id", "label", "v", F.monotonically_increasing_id().alias("_tie"))
    placed = dense_position(rows, [F.col(c) for c in ("_short", "vec_id", "_tie")], "_pos")
    return cut(placed.withColumn("bucket", F.floor(F.col("_pos") / bucket)).groupBy("bucket").applyInArrow(_bucket, _BUCKET))


def _window(place: Column, low: Column, high: Column, same: bool) -> Column:
    return F.struct(place.cast("int").alias("place"), low.cast("long").alias("low"), high.cast("long").alias("high"), F.lit(same).alias("same"))


def _cells(anchors: DataFrame, buckets: DataFrame, k: int, first: bool, slab: int) -> DataFrame:
    """What ``anchors`` (anchor_id, label, v, windows) find in the bucket of the longest vectors, or in all others that can hold something."""
    anchor = F.struct("anchor_id", "label", "v", "windows")
    low = F.array_min(F.transform("windows", lambda w: w["low"]))
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    part = F.pmod(F.xxhash64("anchor_id"), F.lit(max(1, -(-anchors.count() // slab)))).alias("slab")
    # a slab reaches a bucket if any of its anchors does
    slabs = anchors.groupBy(part).agg(F.collect_list(anchor).alias("anchors"), F.min(F.when(low <= 0, 0.0).otherwise(low / F.nullif(size, F.lit(0.0)))).alias("need"))
    places = F.array(F.lit(0).cast("long")) if first else F.slice(F.sequence(F.lit(0).cast("long"), F.lit(max(0, buckets.count() - 1)).cast("long")), 2, 1 << 30)
    met = slabs.select("slab", "need", F.explode(places).alias("bucket")).join(buckets.select("bucket", "longest"), "bucket")
    met = met.where(F.col("need") <= F.col("longest") * (1 + _SLACK))
    slabs = slabs.select("slab", "anchors").join(met.select("slab", "bucket"), "slab")
    slabs = cut(slabs)
    held = buckets.join(slabs.select("slab", "bucket"), "bucket").withColumnsRenamed({"bucket": "to_bucket", "slab": "to_slab"})

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            found = list(_search(left["anchors"].to_pylist()[0], Bucket(right.to_pylist()[0]), k))
        n = [len(x[2]) for x in found]
        columns = [np.repeat([x[0] for x in found], n), np.repeat([x[1] for x in found], n), *[np.concatenate([x[i] for x in found]) if found else [] for i in (2, 3)], np.repeat([x[4] for x in found], n)]
        return pa.Table.from_arrays([pa.array(np.asarray(c, t)) for c, t in zip(columns, (np.int64, np.int32, np.int64, np.int64, np.int64))], ["anchor_id", "place", "vec_id", "score", "looked"])

    return slabs.groupBy("bucket", "slab").cogroup(held.groupBy("to_bucket", "to_slab")).applyInArrow(search, _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _top(anchors: DataFrame, buckets: DataFrame, k: int, slab: int) -> DataFrame:
    """(anchor_id, place, vec_id, score, rank): the best ``k`` of each anchor and window among all vectors. Stored."""
    seeds = cut(_cells(anchors, buckets, k, True, slab))
    least = seeds.groupBy("anchor_id", "place").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
    known = least.where("least IS NOT NULL").groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("place", "least"))).alias("known"))

    def raised(w: Column) -> Column:
        low = F.greatest(w["low"], F.col("known")[w["place"]])  # a window with fewer than k keeps its own
        return F.struct(w["place"].alias("place"), low.alias("low"), w["high"].alias("high"), w["same"].alias("same"))

    sharper = anchors.join(known, "anchor_id", "left").withColumn("windows", F.transform("windows", raised)).drop("known")
    return cut(_best(seeds.unionByName(_cells(cut(sharper), buckets, k, False, slab)), k))


def _hundredths(score: Column, percent: int, up: bool) -> Column:
    """``percent`` hundredths of a whole score, rounded up or down exactly."""
    x = score * percent + (99 if up else 0)
    return F.call_function("div", x - F.pmod(x, F.lit(100)), F.lit(100))


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, bucket: int = BUCKET, slab: int = SLAB,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over (vec_id, label, embedding).

    Positives are the best vectors of the anchor's label; negatives the best of other labels that score between ``low``
    and ``high`` hundredths of the positive.
    """
    numbers = whole_numbers(vectors)
    buckets = index(numbers, bucket)
    chosen = numbers.where(is_anchor).groupBy(F.col("vec_id").alias("anchor_id")).agg(F.min(F.struct("label", "v")).alias("a"))
    anchors = cut(chosen.select("anchor_id", "a.*"))
    every = F.array(_window(F.lit(0), F.lit(LEAST), F.lit(MOST), True))
    found = _top(anchors.withColumn("windows", every), buckets, positives, slab)
    window = lambda p: _window(p["rank"], _hundredths(p["score"], low, True), _hundredths(p["score"], high, False), False)
    wanted = found.groupBy("anchor_id").agg(F.collect_list(F.struct("rank", "score")).alias("p"))
    asked = anchors.join(wanted, "anchor_id").withColumn("windows", F.filter(F.transform("p", window), lambda w: w["low"] <= w["high"])).drop("p")
    hard = _top(cut(asked.where(F.size("windows") > 0)), buckets, negatives, slab)
    pairs = found.select("anchor_id", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return pairs.join(hard.select("anchor_id", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")), ["anchor_id", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
