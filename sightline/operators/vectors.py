"""Exact nearest vectors by a metric index.

Some of the vectors serve as centres; every vector lies in the cell of its nearest centre, and there in a ring of vectors
at like distance from the centre. A ring is one tile, a crowded one several. By the triangle inequality no vector of a
ring is nearer to a query than the ring is to the query's own distance from the centre. A query first searches the ring
it would lie in. The k-th distance found there is a bound for all other rings: those beyond it are never joined with the
query, tiles that no query asks for are not moved, and of the others only the vectors within the bound are looked at.

Cosine distances are searched as distances between vectors of length one, whose order is the same.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.session import cut

#: Most centres of an index. They are one small array in every task.
CENTRES = 1024
#: Vectors of a tile, and queries that meet it at a time.
TILE = 4096
QUERY_TILE = 2048
_SLACK = 1e-9
_FOUND = "query_id long, vec_id long, distance double"


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(values.flatten().to_numpy(zero_copy_only=False), dtype="float64").reshape(len(values), -1)


def _scaled(v: np.ndarray, metric: str) -> np.ndarray:
    """Vectors between which plain distance has the order of the metric."""
    return v / np.linalg.norm(v, axis=1, keepdims=True) if metric == "cosine" else v


def _gaps(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distance of each point to each centre, from differences, so that near ones keep their digits."""
    return np.stack([np.sqrt(((points - c) ** 2).sum(axis=1)) for c in centres], axis=1)


def _distance(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """Distances of one query as they are reported: squared for l2."""
    if metric == "cosine":
        return 1.0 - (v / np.linalg.norm(v, axis=1, keepdims=True)) @ (q / np.linalg.norm(q))
    return ((v - q) ** 2).sum(axis=1)


def _plain(distance: float, metric: str) -> float:
    """Distance between scaled vectors that belongs to a reported one."""
    return math.sqrt(max(0.0, 2 * distance if metric == "cosine" else distance))


@dataclass
class MetricIndex:
    """Stored vectors (cell, ring, vec_id, embedding, near), the directory of rings (cell, ring, n, low, high), and the radius of each cell."""

    centres: np.ndarray
    radii: dict[int, float]
    vectors: DataFrame
    directory: DataFrame
    metric: str
    tile: int


def metric_index(vectors: DataFrame, metric: str = "l2", centres: int | None = None, tile: int = TILE) -> MetricIndex:
    """Index of ``vectors`` (vec_id, embedding). Rows without a vector take no part.

    Centres are rows chosen by a hash of their id: the root of the number of vectors, at most ``CENTRES``. Rings divide the
    mean distance between a centre and the next into as many parts as a mean cell has tiles.
    """
    if metric not in ("l2", "cosine"):
        raise ValueError("metric is 'l2' or 'cosine'")
    rows = vectors.where(F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    n = rows.count()
    wanted = centres or min(CENTRES, max(1, math.isqrt(n)))
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).collect()  # at most CENTRES rows
    points = np.unique(_scaled(np.array([r.embedding for r in chosen], dtype="float64"), metric), axis=0) if chosen else np.zeros((0, 0))
    between = _gaps(points, points) + np.diag(np.full(len(points), np.inf)) if len(points) > 1 else np.ones((1, 1))
    width = float(between.min(axis=1).mean()) / max(1, n // (tile * wanted)) if n > tile * wanted else math.inf

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                gaps = _gaps(_scaled(_matrix(batch["embedding"]), metric), points)
                cell = gaps.argmin(axis=1)
                near = gaps[np.arange(len(cell)), cell]
                ring = np.minimum(near / width, 1 << 40).astype("int64")
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype("int32")), pa.array(ring), pa.array(near), batch["vec_id"], batch["embedding"]], ["cell", "ring", "near", "vec_id", "embedding"])

    placed = cut(rows.mapInArrow(place, "cell int, ring long, near double, vec_id long, embedding array<double>"))
    directory = cut(placed.groupBy("cell", "ring").agg(F.count(F.lit(1)).alias("n"), F.min("near").alias("low"), F.max("near").alias("high")))
    radii = directory.groupBy("cell").agg(F.max("high").alias("radius")).collect()  # one row per centre
    return MetricIndex(points, {r.cell: r.radius for r in radii}, placed, directory, metric, tile)


def _gap(low: str, high: str) -> Column:
    """How far a query's distance from the centre lies outside a ring."""
    return F.greatest(F.lit(0.0), F.col("apart") - F.col(high), F.col(low) - F.col("apart"))


def _rings(queries: DataFrame, index: MetricIndex) -> DataFrame:
    """``queries`` (query_id, reach, first_cell, first_ring) with (cell, apart, ring, n, low, high): the rings within ``reach``, but the first."""
    points, metric, kept = index.centres, index.metric, ["query_id", "reach", "first_cell", "first_ring"]
    cells = np.array(sorted(index.radii), dtype="int32")
    radius = np.array([index.radii[c] for c in cells])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and len(cells):
                gaps = _gaps(_scaled(_matrix(batch["embedding"]), metric), points[cells])
                reach = batch["reach"].to_numpy(zero_copy_only=False)
                rows, at = np.nonzero(gaps - radius <= reach[:, None] * (1 + _SLACK) + _SLACK)
                own = batch.select(kept).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(cells[at]), pa.array(gaps[rows, at])], [*kept, "cell", "apart"])

    met = queries.select(*kept, "embedding").mapInArrow(near, "query_id long, reach double, first_cell int, first_ring long, cell int, apart double")
    rings = met.join(index.directory, "cell").where(_gap("low", "high") <= F.col("reach") * (1 + _SLACK) + _SLACK)
    return rings.where(~((F.col("cell") == F.col("first_cell")) & (F.col("ring") == F.col("first_ring"))))


def first_rings(index: MetricIndex, queries: DataFrame) -> DataFrame:
    """The ring each query would lie in: of the nearest centre, or the one next to it."""
    place = F.struct(F.col("apart").alias("from_centre"), _gap("low", "high").alias("gap"), "cell", "ring", "apart", "n")
    return _rings(queries, index).groupBy("query_id", "reach").agg(F.min(place).alias("p")).select("query_id", "reach", "p.cell", "p.ring", "p.apart", "p.n")


def other_rings(index: MetricIndex, queries: DataFrame) -> DataFrame:
    """All other rings within the reach of each query."""
    return _rings(queries, index).select("query_id", "reach", "cell", "ring", "apart", "n")


def _search(queries: DataFrame, index: MetricIndex, asked: DataFrame, k: int, slabs: int) -> DataFrame:
    """Best ``k`` of every tile for the queries that ``asked`` (query_id, reach, cell, ring, apart, n) sends there."""
    parts = F.ceil(F.col("n") / index.tile)
    pairs = asked.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).join(queries.select("query_id", "embedding"), "query_id")
    pairs = pairs.withColumn("slab", F.pmod(F.xxhash64("query_id"), F.lit(slabs)))
    wanted = asked.select("cell", "ring", "n").distinct()
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slabs - 1).cast("long"))).alias("slab")
    held = index.vectors.join(wanted, ["cell", "ring"]).select("cell", "ring", F.pmod(F.xxhash64("vec_id"), parts).alias("part"), each, "vec_id", "embedding", "near")
    metric = index.metric

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            right = right.sort_by("near")
            ids, v, near = right["vec_id"].to_numpy(), _matrix(right["embedding"]), right["near"].to_numpy()
            reach = left["reach"].to_numpy() * (1 + _SLACK) + _SLACK
            first = np.searchsorted(near, left["apart"].to_numpy() - reach, side="left")
            last = np.searchsorted(near, left["apart"].to_numpy() + reach, side="right")
            for query_id, q, a, b in zip(left["query_id"].to_pylist(), _matrix(left["embedding"]), first, last):
                d = _distance(q, v[a:b], metric)
                best = np.lexsort((ids[a:b], d))[:k]
                found.append((np.full(len(best), query_id), ids[a:b][best], d[best]))
        columns = [np.concatenate(x) for x in zip(*found)] or [[], [], []]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "distance": pa.array(columns[2], pa.float64())})

    tile = ["cell", "ring", "part", "slab"]
    return pairs.groupBy(*tile).cogroup(held.groupBy(*tile)).applyInArrow(look, _FOUND)


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest(index: MetricIndex, queries: DataFrame, k: int = 1, max_distance: float | None = None) -> DataFrame:
    """(query_id, vec_id, distance, rank): the ``k`` nearest vectors of each of ``queries`` (query_id, embedding).

    Ties go to the smaller id. Queries without a vector find nothing; a query_id stands for one query.
    """
    widest = float("inf") if max_distance is None else _plain(max_distance, index.metric)
    given = queries.where(F.col("embedding").isNotNull()).select(
        F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.lit(widest).alias("reach"),
        F.lit(-1).alias("first_cell"), F.lit(-1).cast("long").alias("first_ring"))
    given = cut(given)
    slabs = max(1, -(-given.count() // QUERY_TILE))
    start = cut(first_rings(index, given))
    found = cut(_search(given, index, start, k, slabs))
    kth = found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("kth"))
    plain = F.sqrt(F.when(F.col("kth") <= 0, 0.0).otherwise(F.col("kth") * (2 if index.metric == "cosine" else 1)))
    known = start.select("query_id", F.col("cell").alias("first_cell"), F.col("ring").alias("first_ring")).join(kth, "query_id", "left")
    sharper = given.drop("first_cell", "first_ring").join(known, "query_id").withColumn("reach", F.least("reach", plain))
    rest = _search(given, index, cut(other_rings(index, sharper)), k, slabs)
    best = _top(found.unionByName(rest), k)
    return best if max_distance is None else best.where(F.col("distance") <= max_distance)


def knn(
    queries: DataFrame, vectors: DataFrame, k: int = 1, metric: str = "l2", max_distance: float | None = None,
    small_values: int | None = None, tile: int = TILE,
) -> DataFrame:
    """The ``k`` nearest ``vectors`` (vec_id, embedding) of each of ``queries`` (query_id, embedding).

    L2 distances are squared; ties go to the smaller id. Of several searches over the same vectors, build the index once.
    ``small_values`` decides nothing any more: one way serves any number of queries.
    """
    return nearest(metric_index(vectors, metric, tile=tile), queries, k, max_distance)


def knn_topk(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2", max_distance: float | None = None) -> DataFrame:
    """As :func:`knn`, for many queries over one table of vectors."""
    return knn(queries, vectors, k, metric, max_distance)
