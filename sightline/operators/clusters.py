"""Greedy distance clusters in newest-first order, computed in parallel rounds.

The order decides: a place leads a cluster when no earlier leader lies within ``km``; every other
place belongs to the earliest leader within reach. In a round each tile of the map looks at its
earliest open places, with the border places of its neighbours, and settles those whose earlier
neighbours are all settled; then everything the new leaders reach is closed. A tile never sees
more than ``PER_TILE`` places, cut before the shuffle, so a crowded tile is no larger than the
rest. A track that crosses the map takes a round per tile, not per place. No pair of ordinary
places is ever formed, and the result does not depend on the partitioning.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions.geo import EARTH_RADIUS_KM, SphereGrid, haversine_km
from sightline.operators.curation import first_per_group
from sightline.operators.predicates import has_location, not_removed
from sightline.session import cut

#: Places a tile looks at in one round, and the side of a tile in cluster radii. Spark cuts groups to a constant
#: number of rows before the shuffle only up to spark.sql.optimizer.windowGroupLimitThreshold, 1000 by default.
PER_TILE = 1_000
TILE_SIDE = 16


def _rank():
    """Order key, smallest for the newest sighting; ties go to the smaller id."""
    return F.struct((-F.unix_micros("created_at")).alias("age"), F.col("sighting_id").alias("id"))


def _places(s: DataFrame, grid: SphereGrid) -> DataFrame:
    rows = s.where(has_location(F.col("lng"), F.col("lat")) & not_removed(F.col("is_removed")))
    return (
        rows.groupBy("lng", "lat").agg(F.min(_rank()).alias("rank"), F.count(F.lit(1)).alias("n"))
        .withColumn("cell", grid.cell(F.col("lng"), F.col("lat")))
    )


def _reach(leaders: DataFrame, grid: SphereGrid) -> DataFrame:
    return leaders.select(
        F.explode(grid.cover(F.col("lng"), F.col("lat"))).alias("cell"),
        F.col("lng").alias("lead_lng"), F.col("lat").alias("lead_lat"), F.col("rank").alias("lead_rank"),
    )


def _within(km: float):
    return haversine_km(F.col("lead_lng"), F.col("lead_lat"), F.col("lng"), F.col("lat")) <= km


def _settled_leaders(listed: DataFrame, km: float) -> DataFrame:
    """New leaders among the listed places (tile, own, cell, age, id, lng, lat) of each tile.

    In order: a place near a new leader is closed. A place with an earlier open neighbour stays
    open, and so does a neighbour tile's place, whose own surroundings are not all here. The rest lead.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["age", "id"], ignore_index=True)
        lat, lng, own = np.radians(pdf["lat"].to_numpy()), np.radians(pdf["lng"].to_numpy()), pdf["own"].to_numpy()
        closed, waits, leads = np.zeros(len(pdf), dtype=bool), np.zeros(len(pdf), dtype=bool), []
        for i in range(len(pdf)):
            if closed[i]:
                continue
            a = np.sin((lat - lat[i]) / 2) ** 2 + np.cos(lat) * np.cos(lat[i]) * np.sin((lng - lng[i]) / 2) ** 2
            near = 2 * EARTH_RADIUS_KM * np.arctan2(np.sqrt(a), np.sqrt(np.maximum(1 - a, 0))) <= km
            if own[i] and not waits[i]:
                leads.append(i)
                closed |= near
            else:
                waits |= near
        return pdf.loc[leads, ["cell", "age", "id", "lng", "lat"]]

    done = listed.groupBy("tile").applyInPandas(run, "cell long, age long, id long, lng double, lat double")
    return cut(done.select("cell", F.struct("age", "id").alias("rank"), "lng", "lat"))


def leaders_of(places: DataFrame, km: float, per_tile: int = PER_TILE) -> DataFrame:
    """Leaders (lng, lat, rank, cell) of the distinct places, in rounds over all tiles until none is open."""
    grid, tiles = SphereGrid(km), SphereGrid(km, side_km=TILE_SIDE * km)
    columns = ["cell", F.col("rank.age").alias("age"), F.col("rank.id").alias("id"), "lng", "lat"]
    open_places, rounds = places, []
    while not open_places.isEmpty():
        at = F.col("lng"), F.col("lat")
        listed = open_places.select(F.explode(tiles.cover(*at)).alias("tile"), tiles.cell(*at).alias("home"), *columns)
        # a constant limit on the row number is applied in every task before the shuffle
        earliest = first_per_group(listed, "tile", [F.col("age"), F.col("id")], per_tile)
        new = _settled_leaders(earliest.select("tile", (F.col("tile") == F.col("home")).alias("own"), "cell", "age", "id", "lng", "lat"), km)
        rounds.append(new)
        reach = _reach(new, grid).withColumnRenamed("cell", "lead_cell")
        open_places = cut(open_places.join(reach, (F.col("cell") == F.col("lead_cell")) & _within(km), "left_anti"))
    leaders = rounds[0] if rounds else places.limit(0).select("cell", "rank", "lng", "lat")
    for more in rounds[1:]:
        leaders = leaders.unionByName(more)
    return leaders


def cluster_places(s: DataFrame, km: float = 2.0) -> DataFrame:
    """Every active place with its sighting count and its leader: lng, lat, n, leader_id."""
    grid = SphereGrid(km)
    places = cut(_places(s, grid))
    reach = _reach(leaders_of(places, km), grid)
    return (
        places.join(reach, "cell").where(_within(km))
        .groupBy("lng", "lat").agg(F.first("n").alias("n"), F.min("lead_rank").alias("lead"))
        .select("lng", "lat", "n", F.col("lead.id").alias("leader_id"))
    )


def cluster_leaders(s: DataFrame, km: float = 2.0) -> DataFrame:
    """The leading places: centre_id, centre_lng, centre_lat."""
    places = cut(_places(s, SphereGrid(km)))
    return leaders_of(places, km).select(
        F.col("rank.id").alias("centre_id"), F.col("lng").alias("centre_lng"), F.col("lat").alias("centre_lat")
    )


def leader_clusters(s: DataFrame, km: float = 2.0, min_size: int = 2) -> DataFrame:
    """Clusters with at least ``min_size`` sightings: count, centre, radius in km and species."""
    places = cut(cluster_places(s, km))
    rows = s.where(has_location(F.col("lng"), F.col("lat")) & not_removed(F.col("is_removed")))
    kinds = rows.select("lng", "lat", F.coalesce(F.nullif("predicted_species", F.lit("")), F.lit("Unknown")).alias("species")).distinct()
    species = places.join(kinds, ["lng", "lat"]).groupBy("leader_id").agg(F.sort_array(F.collect_set("species")).alias("species"))
    centres = cut(
        places.groupBy("leader_id")
        .agg(F.sum("n").alias("n"), (F.sum(F.col("lat") * F.col("n")) / F.sum("n")).alias("center_lat"),
             (F.sum(F.col("lng") * F.col("n")) / F.sum("n")).alias("center_lng"))
        .where(F.col("n") >= min_size)
    )
    radius = (
        places.select("leader_id", "lng", "lat").join(centres, "leader_id")
        .groupBy("leader_id").agg(F.max(haversine_km(F.col("center_lng"), F.col("center_lat"), F.col("lng"), F.col("lat"))).alias("radius_km"))
    )
    return (
        centres.join(radius, "leader_id").join(species, "leader_id")
        .select("leader_id", "n", "center_lat", "center_lng", "radius_km", "species")
        .orderBy(F.desc("n"), "leader_id")
    )


def cluster_top(s: DataFrame, n: int = 8, km: float = 2.0, min_size: int = 2) -> DataFrame:
    band = F.when(F.col("n") > 5, "large").when(F.col("n") > 3, "medium").otherwise("small")
    return leader_clusters(s, km, min_size).select("leader_id", "n", band.alias("band")).limit(n)
