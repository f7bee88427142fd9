"""Exact largest distance inside each group, without comparing all pairs.

Points fall into cells of a square lattice over their group's bounding box. A pair of cells can
be dropped when the most it could span is below a distance already reached by real points. The
surviving cell pairs are split further until comparing the points of each is cheap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.geo import KM_PER_DEGREE, haversine_km
from sightline.session import cut

_START_DEPTH = 3
_STEP = 2
_LAST_DEPTH = 26
#: Distances that one pair of cells may take, or per point of the pair.
_DIRECT_PAIRS = 1 << 16
_PAIRS_PER_POINT = 16
_SLACK = 1e-6


def _cell(point: Column, low: Column, high: Column, depth: int) -> Column:
    side = 1 << depth
    return F.when(high > low, F.least(F.floor((point - low) / (high - low) * side), F.lit(side - 1))).otherwise(F.lit(0)).cast("long")


def _extreme_span(points: DataFrame, by: str) -> DataFrame:
    """Per group: bounding box, and the widest span between points extreme in eight directions."""
    # directions around the compass, in degrees of latitude and longitude
    directions = [(1, 0), (0, 1), (1, 1), (1, -1), (2, 1), (1, 2), (2, -1), (1, -2)]
    place = F.struct("lng", "lat")
    picks = []
    for a, b in directions:
        along = F.col("lng") * a + F.col("lat") * b
        picks += [F.max_by(place, along), F.min_by(place, along)]
    boxed = points.groupBy(by).agg(
        F.min("lat").alias("lat0"), F.max("lat").alias("lat1"), F.min("lng").alias("lng0"), F.max("lng").alias("lng1"),
        F.array(*picks).alias("_ends"),
    )
    span = F.array_max(F.transform("_ends", lambda p: F.array_max(
        F.transform("_ends", lambda q: haversine_km(p["lng"], p["lat"], q["lng"], q["lat"]))
    )))
    return boxed.select(by, "lat0", "lat1", "lng0", "lng1", span.alias("reached"))


def _cells(points: DataFrame, by: str) -> DataFrame:
    """Cells with their own tight boxes: centre, radius in km and number of points."""
    lat0, lat1, lng0, lng1 = (F.col(c) for c in ("_a0", "_a1", "_o0", "_o1"))
    nearest = F.when((lat0 <= 0) & (lat1 >= 0), F.lit(0.0)).otherwise(F.least(F.abs(lat0), F.abs(lat1)))
    tall = (lat1 - lat0) / 2 * KM_PER_DEGREE
    wide = (lng1 - lng0) / 2 * KM_PER_DEGREE * F.cos(F.radians(nearest))
    return (
        points.groupBy(by, "cu", "cv")
        .agg(F.count(F.lit(1)).alias("n"), F.min("lat").alias("_a0"), F.max("lat").alias("_a1"),
             F.min("lng").alias("_o0"), F.max("lng").alias("_o1"))
        .select(by, "cu", "cv", "n", ((lat0 + lat1) / 2).alias("clat"), ((lng0 + lng1) / 2).alias("clng"),
                F.sqrt(tall * tall + wide * wide).alias("radius"))
    )


def _pair_up(cells: DataFrame, by: str, reached: DataFrame, parents: DataFrame | None) -> DataFrame:
    """Cell pairs that may still hold the widest span; children of the surviving pairs only."""
    names = ["cu", "cv", "n", "clat", "clng", "radius"]
    left = cells.select(by, *[F.col(c).alias(f"{c}_a") for c in names])
    right = cells.select(by, *[F.col(c).alias(f"{c}_b") for c in names])
    if parents is None:
        pairs = left.join(right, by)  # at most 4**_START_DEPTH cells per group, however many points
    else:
        shift = _STEP
        up = lambda d, s: d.withColumns({f"pu_{s}": F.shiftright(f"cu_{s}", shift), f"pv_{s}": F.shiftright(f"cv_{s}", shift)})
        keys = parents.select(by, *[F.col(f"c{x}_{s}").alias(f"p{x}_{s}") for s in "ab" for x in "uv"])
        pairs = keys.join(up(left, "a"), [by, "pu_a", "pv_a"]).join(up(right, "b"), [by, "pu_b", "pv_b"])
    ordered = (F.col("cu_a") < F.col("cu_b")) | ((F.col("cu_a") == F.col("cu_b")) & (F.col("cv_a") <= F.col("cv_b")))
    most = haversine_km(F.col("clng_a"), F.col("clat_a"), F.col("clng_b"), F.col("clat_b")) + F.col("radius_a") + F.col("radius_b")
    if parents is not None:
        ordered = F.lit(True)
    return (
        pairs.where(ordered).join(reached.select(by, "reached"), by)
        .where(most >= F.col("reached") - _SLACK)
        .select(by, "cu_a", "cv_a", "n_a", "cu_b", "cv_b", "n_b")
    )


def _spans(pairs: DataFrame, placed: DataFrame, by: str) -> DataFrame:
    """Widest span between the points of the given cell pairs, per group."""
    a = placed.select(by, F.col("cu").alias("cu_a"), F.col("cv").alias("cv_a"), F.col("lng").alias("lng_a"), F.col("lat").alias("lat_a"))
    b = placed.select(by, F.col("cu").alias("cu_b"), F.col("cv").alias("cv_b"), F.col("lng").alias("lng_b"), F.col("lat").alias("lat_b"))
    met = pairs.drop("n_a", "n_b").join(a, [by, "cu_a", "cv_a"]).join(b, [by, "cu_b", "cv_b"])
    return met.groupBy(by).agg(F.max(haversine_km(F.col("lng_a"), F.col("lat_a"), F.col("lng_b"), F.col("lat_b"))).alias("span"))


def farthest_pair(rows: DataFrame, by: str) -> DataFrame:
    """(by, diameter_km) over rows with ``by``, ``lng`` and ``lat``.

    Every pair of cells has its own budget: within it the points are measured, beyond it the cells are split, whatever
    the rest of the work. What the measured pairs reach rules out more of the split ones.
    """
    points = cut(rows.select(by, "lng", "lat").distinct())
    reached = cut(_extreme_span(points, by))
    kept, parents, depth = points, None, _START_DEPTH
    within = F.col("n_a") * F.col("n_b") <= F.greatest(F.lit(_DIRECT_PAIRS), _PAIRS_PER_POINT * (F.col("n_a") + F.col("n_b")))
    while True:
        boxed = kept.join(reached.drop("reached"), by)
        placed = boxed.withColumns({
            "cu": _cell(F.col("lat"), F.col("lat0"), F.col("lat1"), depth),
            "cv": _cell(F.col("lng"), F.col("lng0"), F.col("lng1"), depth),
        }).select(by, "lng", "lat", "cu", "cv")
        pairs = cut(_pair_up(_cells(placed, by), by, reached, parents))
        # below the last depth cells are smaller than any measurement
        small = within if depth < _LAST_DEPTH else F.lit(True)
        spans = _spans(pairs.where(small), placed, by)
        reached = cut(reached.join(spans, by, "left").withColumn("reached", F.greatest("reached", F.coalesce("span", F.lit(0.0)))).drop("span"))
        large = pairs.where(~small)
        if large.isEmpty():
            return reached.select(by, F.col("reached").alias("diameter_km"))
        live = large.selectExpr(f"`{by}`", "inline(array(struct(cu_a AS cu, cv_a AS cv), struct(cu_b AS cu, cv_b AS cv)))").distinct()
        kept = cut(placed.join(live, [by, "cu", "cv"], "left_semi").drop("cu", "cv"))
        parents = large
        depth += _STEP
