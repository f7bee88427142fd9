"""Mean great-circle distance over all pairs of points, without forming all pairs.

Equal places collapse into one weighted point. Cells of a square lattice are then paired from
coarse to fine. Two cells that lie far apart for their size contribute through an interpolation
of the distance on a small grid of nodes in each cell, whose error is far below the rounding of
the sum; the pair costs the same whatever the cells hold. Near cells are split, and once both
hold few points the distances are taken directly. The work grows with the number of places.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.geo import EARTH_RADIUS_KM, KM_PER_DEGREE, haversine_km
from sightline.session import cut

_NODES = 8
_FAR = 2.0
_DIRECT = 32_768
_START_DEPTH = 3
_LAST_DEPTH = 28
_WIDEST_DEG = 20.0
_LARGEST_ARC = 0.9 * math.pi * EARTH_RADIUS_KM


def _node_positions() -> list[float]:
    """Chebyshev nodes on [-1, 1]."""
    return [math.cos((2 * i + 1) * math.pi / (2 * _NODES)) for i in range(_NODES)]


def _basis(x: Column, i: int) -> Column:
    """Lagrange polynomial of node i at x in [-1, 1]."""
    nodes = _node_positions()
    out = F.lit(1.0)
    for j, node in enumerate(nodes):
        if j != i:
            out = out * ((x - node) / (nodes[i] - node))
    return out


def _unit(lat: np.ndarray, lng: np.ndarray) -> np.ndarray:
    """Points on the unit sphere, from degrees."""
    lat, lng = np.radians(lat), np.radians(lng)
    return np.stack([np.cos(lat) * np.cos(lng), np.cos(lat) * np.sin(lng), np.sin(lat)], axis=-1)


def _unit_columns(df: DataFrame) -> DataFrame:
    lat, lng = F.radians("lat"), F.radians("lng")
    return df.withColumns({"x": F.cos(lat) * F.cos(lng), "y": F.cos(lat) * F.sin(lng), "z": F.sin(lat)})


def _km(chord: np.ndarray) -> np.ndarray:
    return 2 * EARTH_RADIUS_KM * np.arcsin(np.minimum(chord / 2, 1.0))


def _interpolated_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Weighted distance sum of each far pair of cells from their node weights."""
    x = np.array(_node_positions())
    for pdf in batches:
        total = 0.0
        for lo in range(0, len(pdf), 64):
            part = pdf.iloc[lo:lo + 64]
            rows, at, weights = len(part), {}, {}
            for side in "ab":
                lat = part[f"clat_{side}"].to_numpy()[:, None] + part[f"hlat_{side}"].to_numpy()[:, None] * x
                lng = part[f"clng_{side}"].to_numpy()[:, None] + part[f"hlng_{side}"].to_numpy()[:, None] * x
                lat = np.broadcast_to(lat[:, :, None], (rows, _NODES, _NODES)).reshape(rows, -1)
                lng = np.broadcast_to(lng[:, None, :], (rows, _NODES, _NODES)).reshape(rows, -1)
                at[side], weights[side] = _unit(lat, lng), np.stack(part[f"w_{side}"].to_list())
            chord = np.sqrt(((at["a"][:, :, None, :] - at["b"][:, None, :, :]) ** 2).sum(axis=-1))
            total += float(np.einsum("pi,pij,pj->", weights["a"], _km(chord), weights["b"]))
        yield pd.DataFrame({"total": [total]})


def _direct_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Weighted distance sum of each near pair of small cells, point by point."""
    for pdf in batches:
        total = 0.0
        for places_a, places_b, same in zip(pdf["places_a"], pdf["places_b"], pdf["same"]):
            a, b = np.stack(places_a), np.stack(places_b)
            chord = np.sqrt(sum((a[:, k, None] - b[None, :, k]) ** 2 for k in range(3)))
            met = a[:, 3] @ _km(chord) @ b[:, 3]
            total += float(met) * (0.5 if same else 1.0)  # inside one cell every pair is met twice
        yield pd.DataFrame({"total": [total]})


def _cells(points: DataFrame) -> DataFrame:
    """Lattice cells with centre, half sizes in degrees, radius in km, places and weight."""
    lat0, lat1, lng0, lng1 = (F.col(c) for c in ("_a0", "_a1", "_o0", "_o1"))
    nearest = F.when((lat0 <= 0) & (lat1 >= 0), F.lit(0.0)).otherwise(F.least(F.abs(lat0), F.abs(lat1)))
    hlat, hlng = (lat1 - lat0) / 2, (lng1 - lng0) / 2
    tall, wide = hlat * KM_PER_DEGREE, hlng * KM_PER_DEGREE * F.cos(F.radians(nearest))
    return (
        points.groupBy("cu", "cv")
        .agg(F.count(F.lit(1)).alias("n"), F.min("lat").alias("_a0"), F.max("lat").alias("_a1"),
             F.min("lng").alias("_o0"), F.max("lng").alias("_o1"))
        .select("cu", "cv", "n", ((lat0 + lat1) / 2).alias("clat"), ((lng0 + lng1) / 2).alias("clng"),
                hlat.alias("hlat"), hlng.alias("hlng"), F.sqrt(tall * tall + wide * wide).alias("radius"))
    )


def _pairs(cells: DataFrame, parents: DataFrame | None, direct: int) -> DataFrame:
    names = cells.columns
    left = cells.select(*[F.col(c).alias(f"{c}_a") for c in names])
    right = cells.select(*[F.col(c).alias(f"{c}_b") for c in names])
    if parents is None:
        side = (1 << _START_DEPTH) - 1  # every cell lists all cells of the coarse lattice
        each = F.sequence(F.lit(0).cast("long"), F.lit(side).cast("long"))
        listed = left.withColumn("cu_b", F.explode(each)).withColumn("cv_b", F.explode(each))
        pairs = listed.join(right, ["cu_b", "cv_b"])
    else:
        def up(d: DataFrame, s: str) -> DataFrame:
            return d.withColumns({f"pu_{s}": F.shiftright(f"cu_{s}", 1), f"pv_{s}": F.shiftright(f"cv_{s}", 1)})
        pairs = parents.join(up(left, "a"), ["pu_a", "pv_a"]).join(up(right, "b"), ["pu_b", "pv_b"])
    ordered = (F.col("cu_a") < F.col("cu_b")) | ((F.col("cu_a") == F.col("cu_b")) & (F.col("cv_a") <= F.col("cv_b")))
    if parents is not None:  # only the children of one cell would meet twice
        ordered = ordered | (F.col("pu_a") != F.col("pu_b")) | (F.col("pv_a") != F.col("pv_b"))
    apart = haversine_km(F.col("clng_a"), F.col("clat_a"), F.col("clng_b"), F.col("clat_b"))
    size = F.col("radius_a") + F.col("radius_b")
    narrow = F.greatest("hlat_a", "hlng_a", "hlat_b", "hlng_b") * 2 <= _WIDEST_DEG
    work = F.col("n_a") * F.col("n_b")
    far = (apart >= _FAR * size) & (apart + size <= _LARGEST_ARC) & narrow & (apart > 0)
    kind = F.when(work <= direct, "direct").when(far, "far").otherwise("near")
    return pairs.where(ordered).withColumn("kind", kind).drop("pu_a", "pv_a", "pu_b", "pv_b")


def _direct_sum(pairs: DataFrame, points: DataFrame) -> DataFrame:
    near = pairs.where(F.col("kind") == "direct").select("cu_a", "cv_a", "cu_b", "cv_b")
    used = near.selectExpr("inline(array(struct(cu_a AS cu, cv_a AS cv), struct(cu_b AS cu, cv_b AS cv)))").distinct()
    # cells in direct pairs are small, so their places fit in one value
    held = (
        _unit_columns(points.join(used, ["cu", "cv"], "left_semi"))
        .groupBy("cu", "cv").agg(F.collect_list(F.array("x", "y", "z", "w")).alias("places"))
    )
    a, b = (held.select(*[F.col(c).alias(f"{c}_{s}") for c in ("cu", "cv", "places")]) for s in "ab")
    same = (F.col("cu_a") == F.col("cu_b")) & (F.col("cv_a") == F.col("cv_b"))
    joined = near.join(a, ["cu_a", "cv_a"]).join(b, ["cu_b", "cv_b"]).select("places_a", "places_b", same.alias("same"))
    return _spread(joined).mapInPandas(_direct_sums, "total double").agg(F.sum("total").alias("total"))


def _spread(df: DataFrame) -> DataFrame:
    """Pairs are few bytes but much arithmetic: use every core whatever their size."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def _far_sum(pairs: DataFrame, points: DataFrame, cells: DataFrame) -> DataFrame:
    far = pairs.where(F.col("kind") == "far")
    used = far.selectExpr("inline(array(struct(cu_a AS cu, cv_a AS cv), struct(cu_b AS cu, cv_b AS cv)))").distinct()
    inside = points.join(cells.join(used, ["cu", "cv"], "left_semi"), ["cu", "cv"])
    u = F.when(F.col("hlat") > 0, (F.col("lat") - F.col("clat")) / F.col("hlat")).otherwise(0.0)
    v = F.when(F.col("hlng") > 0, (F.col("lng") - F.col("clng")) / F.col("hlng")).otherwise(0.0)
    based = inside.select("cu", "cv", "w", u.alias("u"), v.alias("v")).select(
        "cu", "cv", "w", *[_basis(F.col("u"), i).alias(f"u{i}") for i in range(_NODES)],
        *[_basis(F.col("v"), i).alias(f"v{i}") for i in range(_NODES)],
    )
    sums = [F.sum(F.col("w") * F.col(f"u{i}") * F.col(f"v{j}")) for i in range(_NODES) for j in range(_NODES)]
    weights = based.groupBy("cu", "cv").agg(F.array(*sums).alias("weights"))
    wa = weights.select(F.col("cu").alias("cu_a"), F.col("cv").alias("cv_a"), F.col("weights").alias("w_a"))
    wb = weights.select(F.col("cu").alias("cu_b"), F.col("cv").alias("cv_b"), F.col("weights").alias("w_b"))
    boxed = far.join(wa, ["cu_a", "cv_a"]).join(wb, ["cu_b", "cv_b"])
    columns = [f"{c}_{s}" for s in "ab" for c in ("clat", "clng", "hlat", "hlng", "w")]
    return _spread(boxed.select(*columns)).mapInPandas(_interpolated_sums, "total double").agg(F.sum("total").alias("total"))


def mean_pair_distance(rows: DataFrame, direct: int = _DIRECT) -> DataFrame:
    """One row: avg_km (NULL without pairs) and pairs, over rows with ``lng`` and ``lat``.

    ``direct`` is the largest number of place pairs that two near cells may compare one by one.
    """
    spark = rows.sparkSession
    places = cut(rows.groupBy("lng", "lat").agg(F.count(F.lit(1)).cast("double").alias("w")))
    box = places.agg(F.min("lat"), F.max("lat"), F.min("lng"), F.max("lng"), F.sum("w")).first()
    lat0, lat1, lng0, lng1, total = box
    pairs_n = 0 if total is None else int(total) * (int(total) - 1) // 2
    if pairs_n == 0:
        return spark.createDataFrame([(None, 0)], "avg_km double, pairs long")

    def cell(c: str, low: float, high: float, depth: int) -> Column:
        if not high > low:
            return F.lit(0).cast("long")
        side = 1 << depth
        return F.least(F.floor((F.col(c) - low) / (high - low) * side), F.lit(side - 1)).cast("long")

    sums, parents = [], None
    for depth in range(_START_DEPTH, _LAST_DEPTH + 1):
        points = places.withColumns({"cu": cell("lat", lat0, lat1, depth), "cv": cell("lng", lng0, lng1, depth)})
        cells = _cells(points)
        pairs = cut(_pairs(cells, parents, direct))
        if depth == _LAST_DEPTH:
            pairs = pairs.withColumn("kind", F.when(F.col("kind") == "near", "direct").otherwise(F.col("kind")))
        kinds = {r["kind"] for r in pairs.groupBy("kind").count().collect()}
        if "direct" in kinds:
            sums.append(_direct_sum(pairs, points))
        if "far" in kinds:
            sums.append(_far_sum(pairs, points, cells))
        if "near" not in kinds:
            break
        near = pairs.where(F.col("kind") == "near")
        parents = near.select(*[F.col(f"c{x}_{s}").alias(f"p{x}_{s}") for s in "ab" for x in "uv"])
    whole = sums[0]
    for part in sums[1:]:
        whole = whole.unionByName(part)
    return whole.agg((F.sum("total") / F.lit(float(pairs_n))).alias("avg_km"), F.lit(pairs_n).cast("long").alias("pairs"))
