"""Cells, ranges and distances over located sightings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.geo import SphereGrid, grid_cell, haversine_km, round_half_up
from sightline.functions.risk import age_color, sighting_color
from sightline.functions.text import label_short
from sightline.operators.diameter import farthest_pair
from sightline.operators.ordinals import following_rows
from sightline.operators.pair_mean import mean_pair_distance
from sightline.operators.predicates import has_location, not_removed
from sightline.session import cut

DISTANCE_BINS = ["0-1km", "1-5km", "5-10km", "10-20km", "20km+"]


def located(s: DataFrame, drop_null_island: bool = False) -> DataFrame:
    """Rows with coordinates. A capture without a position is stored at (0, 0) and may be dropped."""
    rows = s.where(has_location(F.col("lng"), F.col("lat")))
    if drop_null_island:
        rows = rows.where((F.col("lng") != 0) | (F.col("lat") != 0))
    return rows


def active(s: DataFrame) -> DataFrame:
    return s.where(not_removed(F.col("is_removed")))


def species_or(default: str) -> Column:
    return F.coalesce(F.nullif("predicted_species", F.lit("")), F.lit(default))


def _cells(s: DataFrame, cell: float) -> DataFrame:
    return s.select(
        grid_cell(F.col("lat"), cell).alias("cell_lat"), grid_cell(F.col("lng"), cell).alias("cell_lng"),
        species_or("Unknown").alias("species"),
    )


def hotspots(s: DataFrame, cell: float = 0.01, min_n: int = 3) -> DataFrame:
    """Cells with at least ``min_n`` active sightings."""
    # counted per cell and species first: a hot cell travels as one row per species
    per_species = _cells(located(active(s)), cell).groupBy("cell_lat", "cell_lng", "species").agg(F.count(F.lit(1)).alias("n"))
    return (
        per_species.groupBy("cell_lat", "cell_lng")
        .agg(F.sum("n").alias("n"), F.sort_array(F.collect_list("species")).alias("species"))
        .where(F.col("n") >= min_n)
        .select(
            "cell_lat", "cell_lng", (F.col("cell_lat") * cell).alias("lat"), (F.col("cell_lng") * cell).alias("lng"), "n", "species"
        )
        .orderBy(F.desc("n"), "cell_lat", "cell_lng")
    )


def count_hotspots(s: DataFrame, cell: float = 0.01, min_n: int = 3) -> DataFrame:
    """Number of hotspots as a one-row table."""
    cells = _cells(located(active(s)), cell).groupBy("cell_lat", "cell_lng").agg(F.count(F.lit(1)).alias("n"))
    return cells.agg(F.count_if(F.col("n") >= min_n).alias("hotspots"))


def top_hotspots(s: DataFrame, n: int = 3, cell: float = 0.01, min_n: int = 3) -> DataFrame:
    return hotspots(s, cell, min_n).limit(n)


def density_summary(s: DataFrame, cell: float = 0.01, share: float = 0.7) -> DataFrame:
    """Largest and mean cell count, and how many cells reach ``share`` of the largest."""
    cells = _cells(located(s), cell).groupBy("cell_lat", "cell_lng").agg(F.count(F.lit(1)).alias("n"))
    top = cells.agg(F.max("n")).scalar()
    return cells.agg(
        F.max("n").alias("max_density"),
        F.avg("n").alias("mean_density"),
        F.count_if(F.col("n") >= top * share).alias("dense_cells"),
        F.count(F.lit(1)).alias("cells"),
    )


def viewport(s: DataFrame) -> DataFrame:
    return located(s).agg(
        F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"), F.min("lng").alias("min_lng"), F.max("lng").alias("max_lng")
    )


def avg_pair_distance(s: DataFrame) -> DataFrame:
    """Mean distance over all pairs of active located sightings, and the number of pairs."""
    return mean_pair_distance(located(active(s)).select("lng", "lat"))


def coverage_stats(s: DataFrame) -> DataFrame:
    """Area of the bounding box, mean pair distance and the coverage score."""
    box = located(active(s)).agg(
        F.min("lat").alias("a"), F.max("lat").alias("b"), F.min("lng").alias("c"), F.max("lng").alias("d")
    )
    area = haversine_km(F.col("c"), F.col("a"), F.col("c"), F.col("b")) * haversine_km(F.col("c"), F.col("a"), F.col("d"), F.col("a"))
    mean = avg_pair_distance(s).select("avg_km").scalar()
    sized = box.select(F.coalesce(area, F.lit(0.0)).alias("total_area"), F.coalesce(mean, F.lit(0.0)).alias("avg_distance"))
    score = round_half_up(F.col("total_area") / F.greatest(F.col("avg_distance"), F.lit(1.0)))
    return sized.select("total_area", "avg_distance", score.alias("score"))


def species_diameter(s: DataFrame) -> DataFrame:
    """Largest distance between two active sightings of each species; 0 for a single place."""
    rows = located(active(s)).select(species_or("Unknown Species").alias("species"), "lng", "lat")
    return farthest_pair(rows, "species")


def species_range_top(s: DataFrame, n: int = 8) -> DataFrame:
    """Species with the widest range in whole km, removed rows included."""
    everyone = s.select(species_or("Unknown").alias("species")).distinct()
    reach = farthest_pair(located(s).select(species_or("Unknown").alias("species"), "lng", "lat"), "species")
    km = F.coalesce(round_half_up(F.col("diameter_km")), F.lit(0))
    return (
        everyone.join(reach, "species", "left")
        .select("species", label_short(F.col("species")).alias("label"), km.alias("range_km"))
        .withColumn("band", F.when(F.col("range_km") > 10, "wide").when(F.col("range_km") > 5, "medium").otherwise("narrow"))
        .orderBy(F.desc("range_km"), "species")
        .limit(n)
    )


def species_count_top(s: DataFrame, n: int = 8) -> DataFrame:
    return (
        s.groupBy(species_or("Unknown").alias("species")).agg(F.count(F.lit(1)).alias("n"))
        .select("species", label_short(F.col("species")).alias("label"), "n")
        .orderBy(F.desc("n"), "species").limit(n)
    )


def distance_from_first(s: DataFrame) -> DataFrame:
    """Distance of each active located sighting from the earliest one of its species.

    The earliest place is one row per species. It is stored first: its true size then tells the
    optimizer whether it can be broadcast, and the sightings need not be shuffled.
    """
    rows = located(active(s)).select("sighting_id", "created_at", species_or("Unknown").alias("species"), "lng", "lat")
    first = cut(rows.groupBy("species").agg(
        F.min_by(F.struct("lng", "lat", "sighting_id"), F.struct("created_at", "sighting_id")).alias("first")
    ))
    return rows.join(first, "species").select(
        "sighting_id", "species", (F.col("sighting_id") == F.col("first.sighting_id")).alias("is_first"),
        haversine_km(F.col("first.lng"), F.col("first.lat"), F.col("lng"), F.col("lat")).alias("km"),
    )


def spread_by_species(s: DataFrame) -> DataFrame:
    return distance_from_first(s).groupBy("species").agg(F.max("km").alias("spread_km"), F.count(F.lit(1)).alias("n"))


def spread_patterns(s: DataFrame, km: float = 5.0) -> DataFrame:
    """Number of species that spread further than ``km`` from where they were first seen."""
    return spread_by_species(s).agg(F.count_if(F.col("spread_km") > km).alias("spreading_species"))


def near_row_pairs(s: DataFrame, ahead: int = 4) -> DataFrame:
    """Each located sighting of an owner with the next ``ahead`` in newest-first order."""
    pairs = following_rows(
        located(s), "owner", [F.desc("created_at"), F.col("sighting_id")], ["sighting_id", "created_at", "lng", "lat"], ahead
    )
    km = haversine_km(F.col("lng"), F.col("lat"), F.col("next_lng"), F.col("next_lat"))
    return pairs.select("owner", "sighting_id", "step", "next_sighting_id", km.alias("km"))


def distance_bin(km: Column) -> Column:
    d = round_half_up(km)
    return (
        F.when(d < 1, "0-1km").when(d < 5, "1-5km").when(d < 10, "5-10km").when(d < 20, "10-20km").otherwise("20km+")
    )


def distance_histogram(s: DataFrame, ahead: int = 4) -> DataFrame:
    """Counts of row-pair distances in five ranges, empty ranges kept."""
    bins = s.sparkSession.createDataFrame([(i, b) for i, b in enumerate(DISTANCE_BINS)], "bin_no int, bin string")
    counts = near_row_pairs(s, ahead).groupBy(distance_bin(F.col("km")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return bins.join(counts, "bin", "left").select("bin_no", "bin", F.coalesce("n", F.lit(0)).alias("n")).orderBy("bin_no")


def newest_first() -> Column:
    """Sort key whose largest value is the newest sighting, ties by the smaller id."""
    return F.struct(F.col("created_at"), (-F.col("sighting_id")).alias("k"))


def newest_per_cell(s: DataFrame, tol: float = 1e-4) -> DataFrame:
    rows = located(s)
    return (
        rows.groupBy(grid_cell(F.col("lat"), tol).alias("cell_lat"), grid_cell(F.col("lng"), tol).alias("cell_lng"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max_by(F.struct("sighting_id", "created_at", "lng", "lat", "predicted_species"), newest_first()).alias("newest"),
        )
    )


def marker_cells(s: DataFrame, as_of: Column, tol: float = 1e-4) -> DataFrame:
    """One marker per 0.0001 degree cell: its count, newest member, position and colour.

    A lone sighting has the colour of its species; a group has the age colour of its newest member.
    """
    newest = F.col("newest")
    lone = sighting_color(newest["predicted_species"], newest["created_at"], as_of)
    color = F.when(F.col("n") == 1, lone).otherwise(age_color(newest["created_at"], as_of))
    return newest_per_cell(s, tol).select(
        "cell_lat", "cell_lng", "n", newest["sighting_id"].alias("newest_id"), newest["lat"].alias("lat"),
        newest["lng"].alias("lng"), color.alias("color"),
    )


def within_km(points: DataFrame, centres: DataFrame, km: float = 2.0) -> DataFrame:
    """Range join: points (lng, lat, ...) with centres (centre_id, centre_lng, centre_lat) within ``km``.

    Centres are copied to the few cells their circle touches and joined on the cell; only then is
    the distance checked. Work grows with the points and the matches, never with all pairs.
    """
    grid = SphereGrid(km)
    spread = centres.withColumn("_cell", F.explode(grid.cover(F.col("centre_lng"), F.col("centre_lat"))))
    return (
        points.withColumn("_cell", grid.cell(F.col("lng"), F.col("lat")))
        .join(spread, "_cell")
        .withColumn("km", haversine_km(F.col("centre_lng"), F.col("centre_lat"), F.col("lng"), F.col("lat")))
        .where(F.col("km") <= km)
        .drop("_cell")
    )
