"""Spatial operators against brute force, with hot groups and awkward places on the sphere."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sightline.functions.geo import SphereGrid, grid_cell, haversine_km
from sightline.operators import clusters, spatial
from sightline.operators.diameter import farthest_pair
from sightline.operators.ordinals import following_rows, row_index
from sightline.operators.pair_mean import mean_pair_distance

COLUMNS = "sighting_id long, owner long, lng double, lat double, predicted_species string, created_at timestamp, is_removed boolean"


def km(a, b):
    lat1, lat2 = math.radians(a[1]), math.radians(b[1])
    h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * 6371 * math.atan2(math.sqrt(h), math.sqrt(max(0.0, 1 - h)))


def make(spark, places, seed=1):
    """Sightings at the places; a third of them belong to one owner and species."""
    rng = np.random.default_rng(seed)
    rows = []
    for i, (lng, lat) in enumerate(places):
        hot = rng.random() < 0.34
        ts = 1_700_000_000 + int(rng.integers(0, 5_000))
        rows.append((i, 1 if hot else int(rng.integers(2, 5)), float(lng), float(lat), "Hot" if hot else f"S{int(rng.integers(0, 3))}", ts, False))
    df = spark.createDataFrame(rows, COLUMNS.replace("created_at timestamp", "created_at long"))
    return df.withColumn("created_at", F.timestamp_seconds("created_at")), rows


def scattered(n, box, seed):
    rng = np.random.default_rng(seed)
    return [(rng.uniform(box[0], box[2]), rng.uniform(box[1], box[3])) for _ in range(n)]


BOXES = {
    "city": (28.0, -26.0, 28.3, -25.7), "antimeridian": (179.95, -17.0, 180.0, -16.9), "pole": (-180.0, 89.9, 180.0, 90.0),
    "globe": (-180.0, -90.0, 180.0, 90.0), "equator": (-0.1, -0.1, 0.1, 0.1),
}


def greedy(rows, limit=2.0):
    """The sequential clustering, newest first."""
    order = sorted(rows, key=lambda r: (-r[5], r[0]))
    taken, out = set(), {}
    for r in order:
        if r[0] in taken:
            continue
        taken.add(r[0])
        out[r[0]] = {r[0]}
        for o in order:
            if o[0] not in taken and km((r[2], r[3]), (o[2], o[3])) <= limit:
                out[r[0]].add(o[0])
                taken.add(o[0])
    return out


@pytest.mark.parametrize("box", BOXES)
def test_clusters_match_the_loop(spark, box):
    places = scattered(150, BOXES[box], 3)
    if box == "antimeridian":
        places = [(lng if i % 2 else lng - 359.97, lat) for i, (lng, lat) in enumerate(places)]
    places += places[:10]
    s, rows = make(spark, places)
    want = {lead: len(m) for lead, m in greedy(rows).items() if len(m) >= 2}
    got = {r["leader_id"]: r["n"] for r in clusters.leader_clusters(s).collect()}
    assert got == want


def test_a_track_needs_few_rounds(spark, monkeypatch):
    """Places along a line, newest first from one end: the order is one long chain."""
    track = [(28.0 + i * 0.012, -26.0) for i in range(120)]
    rows = [(i, 1, lng, lat, "A", 2_000_000_000 - i, False) for i, (lng, lat) in enumerate(track)]
    s = spark.createDataFrame(rows, COLUMNS.replace("created_at timestamp", "created_at long")).withColumn("created_at", F.timestamp_seconds("created_at"))
    calls = []
    settle = clusters._settled_leaders
    monkeypatch.setattr(clusters, "_settled_leaders", lambda *a: calls.append(1) or settle(*a))
    got = {r["leader_id"]: r["n"] for r in clusters.leader_clusters(s).collect()}
    assert got == {lead: len(m) for lead, m in greedy(rows).items() if len(m) >= 2}
    assert len(calls) <= 8


def test_crowded_tile_is_settled_in_parts(spark):
    s, rows = make(spark, scattered(200, BOXES["city"], 13))
    places = clusters._places(s, SphereGrid(2.0))
    leaders = {r["rank"]["id"] for r in clusters.leaders_of(places, 2.0, per_tile=40).collect()}
    assert leaders == set(greedy(rows))


def test_cluster_facts(spark):
    s, _ = make(spark, [(28.0, -26.0), (28.0, -26.0), (28.01, -26.0), (29.0, -26.0)])
    c = clusters.leader_clusters(s).collect()
    assert len(c) == 1 and c[0]["n"] == 3
    assert c[0]["center_lng"] == pytest.approx((28.0 + 28.0 + 28.01) / 3)
    assert c[0]["radius_km"] == pytest.approx(km((c[0]["center_lng"], -26.0), (28.01, -26.0)))


@pytest.mark.parametrize("box", BOXES)
def test_range_join(spark, box):
    points = scattered(120, BOXES[box], 5)
    centres = scattered(25, BOXES[box], 6)
    p = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(points)], "id long, lng double, lat double")
    c = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(centres)], "centre_id long, centre_lng double, centre_lat double")
    got = {(r["id"], r["centre_id"]) for r in spatial.within_km(p, c, 5.0).collect()}
    want = {(i, j) for i, a in enumerate(points) for j, b in enumerate(centres) if km(a, b) <= 5.0}
    assert got == want


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(lng=st.floats(-180, 180), lat=st.floats(-90, 90), bearing=st.floats(0, 2 * math.pi), share=st.floats(0, 0.999))
def test_cover_holds_every_near_cell(spark, lng, lat, bearing, share):
    grid, d = SphereGrid(2.0), 2.0 * share / 6371
    la = math.radians(lat)
    lat2 = math.asin(max(-1, min(1, math.sin(la) * math.cos(d) + math.cos(la) * math.sin(d) * math.cos(bearing))))
    lng2 = math.radians(lng) + math.atan2(math.sin(bearing) * math.sin(d) * math.cos(la), math.cos(d) - math.sin(la) * math.sin(lat2))
    lng2 = (math.degrees(lng2) + 540) % 360 - 180
    r = spark.range(1).select(
        grid.cover(F.lit(lng), F.lit(lat)).alias("cover"), grid.cell(F.lit(lng2), F.lit(math.degrees(lat2))).alias("cell")).first()
    assert r["cell"] in r["cover"]
    assert len(r["cover"]) <= 64


@pytest.mark.parametrize("box", BOXES)
def test_diameter(spark, box, monkeypatch):
    from sightline.operators import diameter

    monkeypatch.setattr(diameter, "_DIRECT_PAIRS", 200)  # forces the splitting of cells
    monkeypatch.setattr(diameter, "_PAIRS_PER_POINT", 1)
    places = scattered(120, BOXES[box], 7) + [(0.0, 0.0)]
    s, rows = make(spark, places)
    got = {r["species"]: r["diameter_km"] for r in farthest_pair(s.select(F.col("predicted_species").alias("species"), "lng", "lat"), "species").collect()}
    for species in {r[4] for r in rows}:
        own = [(r[2], r[3]) for r in rows if r[4] == species]
        want = max((km(a, b) for a in own for b in own), default=0.0)
        assert got[species] == pytest.approx(want, abs=1e-5)


def test_diameter_of_one_place(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 2.0)], "species string, lng double, lat double")
    assert farthest_pair(df, "species").first()["diameter_km"] == 0.0


@pytest.mark.parametrize("box", BOXES)
def test_mean_pair_distance(spark, box):
    places = scattered(250, BOXES[box], 11)
    places += places[:40]
    df = spark.createDataFrame([tuple(map(float, p)) for p in places], "lng double, lat double")
    want = np.mean([km(a, b) for i, a in enumerate(places) for b in places[i + 1:]])
    r = mean_pair_distance(df, direct=64).first()
    assert r["pairs"] == len(places) * (len(places) - 1) // 2
    assert r["avg_km"] == pytest.approx(want, rel=1e-9)


def test_mean_uses_interpolation(spark):
    """Two far towns of many places: the pair of cells is met through its nodes."""
    places = scattered(150, (28.0, -26.0, 28.02, -25.98), 1) + scattered(150, (28.5, -25.6, 28.52, -25.58), 2)
    df = spark.createDataFrame([tuple(map(float, p)) for p in places], "lng double, lat double")
    want = np.mean([km(a, b) for i, a in enumerate(places) for b in places[i + 1:]])
    assert mean_pair_distance(df, direct=4).first()["avg_km"] == pytest.approx(want, rel=1e-9)


def test_mean_of_nothing(spark):
    empty = spark.createDataFrame([], "lng double, lat double")
    assert tuple(mean_pair_distance(empty).first()) == (None, 0)


def test_near_rows_cross_bucket_borders(spark, monkeypatch):
    from sightline.operators import ordinals

    monkeypatch.setattr(ordinals, "BUCKET", 7)
    s, rows = make(spark, scattered(100, BOXES["city"], 9))
    got = {(r["sighting_id"], r["next_sighting_id"], r["step"]) for r in spatial.near_row_pairs(s).collect()}
    want = set()
    for owner in {r[1] for r in rows}:
        order = sorted((r for r in rows if r[1] == owner), key=lambda r: (-r[5], r[0]))
        want |= {(order[i][0], order[i + k][0], k) for i in range(len(order)) for k in range(1, 5) if i + k < len(order)}
    assert got == want


def test_row_index(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3 == 0).cast("string").alias("g"))
    got = {(r["g"], r["id"]): r["idx"] for r in row_index(df, ["g"], [F.col("id")]).collect()}
    for g in ("true", "false"):
        ids = sorted(i for (h, i) in got if h == g)
        assert [got[(g, i)] for i in ids] == list(range(len(ids)))


def test_following_rows_skip_other_groups(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "g string, v int")
    got = {tuple(r) for r in following_rows(df, "g", [F.col("v")], ["v"], 2).select("g", "v", "next_v").collect()}
    assert got == {("a", 1, 2)}


def test_cells_round_half_up(spark):
    r = spark.createDataFrame([(-2.5,), (2.5,), (-0.5,)], "x double").select(grid_cell(F.col("x"), 1.0).alias("c")).collect()
    assert [x["c"] for x in r] == [-2, 3, 0]


def test_haversine_antipodes(spark):
    r = spark.range(1).select(haversine_km(F.lit(0.0), F.lit(0.0), F.lit(180.0), F.lit(0.0)).alias("d")).first()
    assert r["d"] == pytest.approx(math.pi * 6371)


def test_null_island_option(spark):
    s, _ = make(spark, [(0.0, 0.0), (28.0, -26.0)])
    assert spatial.located(s).count() == 2
    assert spatial.located(s, drop_null_island=True).count() == 1
