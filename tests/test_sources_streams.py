"""Readers, sinks and streams fed file by file."""

import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F
from sightline.operators import pages as pg
from sightline.session import new_path
from sightline.sources import readers, tables as tb
from sightline.streaming import feeds


def test_photo_columns_are_found_by_name(spark, tmp_path):
    p = tmp_path / "photos.csv.gz"
    with gzip.open(p, "wt") as f:
        f.write("photo_uuid\tphoto_id\tobservation_uuid\tLicense\nu\t1\to1\tCC0\nu\t2\to2\n\nu\t3\to3\tCC-BY\n")
    got = {(r["photo_id"], r["observation_id"], r["license"]) for r in readers.read_photo_metadata(spark, str(p)).collect()}
    assert got == {("1", "o1", "CC0"), ("3", "o3", "CC-BY")}
    bad = tmp_path / "bad.csv"
    bad.write_text("photo_id\tobservation_uuid\n1\to\n")
    with pytest.raises(ValueError, match="license"):
        readers.read_photo_metadata(spark, str(bad))


def test_required_columns(spark, tmp_path):
    p = tmp_path / "taxa.csv"
    p.write_text("id\tname\n1\ta\n")
    with pytest.raises(ValueError, match="taxon_id"):
        readers.read_taxa(spark, str(p))


def test_class_names(spark, tmp_path):
    p = tmp_path / "names.txt"
    p.write_text("Acacia_mearnsii\n\n  Lantana_camara \nBrand21\n")
    assert [tuple(r) for r in readers.read_class_names(spark, str(p)).collect()] == [
        (0, "Acacia_mearnsii"), (1, "Lantana_camara"), (2, "Brand21")]


def test_page_files(spark, tmp_path):
    (tmp_path / "page_012.txt").write_text("twelve\nlines")
    (tmp_path / "page_003.txt").write_text("three")
    got = {(r["page_no"], r["text"]) for r in readers.read_page_texts(spark, str(tmp_path / "page_*.txt")).collect()}
    assert got == {(12, "twelve\nlines"), (3, "three")}


def test_species_json(spark, tmp_path):
    p = tmp_path / "species.json"
    p.write_text(json.dumps([{"scientific_name": "A b", "common_names": ["x"], "page_hint": 3}, {"scientific_name": "C d"}], indent=1))
    rows = {r["scientific_name"]: r for r in readers.read_species_json(spark, str(p)).collect()}
    assert rows["A b"]["common_names"] == ["x"] and rows["C d"]["page_hint"] is None


def test_nested_sightings(spark, tmp_path):
    p = tmp_path / "s.json"
    p.write_text(json.dumps({"_id": 1, "owner": 2, "imagePath": "/a.jpg", "fromVideo": False, "location": {"coordinates": [28.1, -25.9]},
                             "analysis": {"predictedSpecies": "A", "confidence": 0.5, "llm": {"status": "completed", "details": {"risk_level": "High"}}},
                             "createdAt": "2024-01-01T00:00:00Z", "capturedAt": None, "isRemoved": False, "removedAt": None, "removedBy": None}))
    nested = spark.read.schema(
        "_id long, owner long, imagePath string, fromVideo boolean, location struct<coordinates:array<double>>, analysis struct<predictedSpecies:string,"
        "confidence:double,llm:struct<status:string,details:struct<risk_level:string>>>, createdAt timestamp, capturedAt timestamp, isRemoved boolean,"
        "removedAt timestamp, removedBy string").json(str(p))
    r = readers.flatten_sightings(nested).first()
    assert (r["lng"], r["lat"], r["risk_level"]) == (28.1, -25.9, "High")


@pytest.mark.parametrize("centres, split", [([100, 110, 480, 490], 295.0), ([100], 300.0), ([20, 150], 180.0)])
def test_gutter(spark, centres, split):
    rows = [(1, 600.0, 800.0, c - 10.0, 100.0 + i, c + 10.0, 110.0 + i, f"t{i}", i, 0) for i, c in enumerate(centres)]
    cols = "page_no long, page_width double, page_height double, x0 double, y0 double, x1 double, y1 double, text string, block_no int, block_type int"
    assert pg.gutter_split(spark.createDataFrame(rows, cols)).first()["split_x"] == pytest.approx(split)


def test_assembled_page(spark):
    cols = "page_no long, page_width double, page_height double, x0 double, y0 double, x1 double, y1 double, text string, block_no int, block_type int"
    long = "words " * 12
    rows = [(1, 600.0, 800.0, 320.0, 100.0, 560.0, 120.0, "right " + long, 0, 0), (1, 600.0, 800.0, 40.0, 200.0, 280.0, 220.0, "left two " + long, 1, 0),
            (1, 600.0, 800.0, 40.0, 100.0, 280.0, 120.0, "left one", 2, 0), (1, 600.0, 800.0, 290.0, 780.0, 310.0, 790.0, "17", 3, 0),
            (2, 600.0, 800.0, 320.0, 50.0, 560.0, 60.0, "b", 0, 0), (2, 600.0, 800.0, 40.0, 90.0, 280.0, 95.0, "a", 1, 0)]
    got = {r["page_no"]: r["text"] for r in pg.assemble_pages(spark.createDataFrame(rows, cols)).collect()}
    assert got[1] == f"left one\nleft two {long.strip()}\n<<COLBREAK>>\nright {long.strip()}"
    assert got[2] == "b\na"


def replay(spark, tmp_path, batches, schema):
    """Write the batches as files and stream them one file at a time."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


T0 = dt.datetime(2024, 1, 1, 10)
SIGHTING = "sighting_id long, owner long, lng double, lat double, predicted_species string, risk_level string, is_removed boolean, created_at timestamp"


def sight(i, minutes, species="A", lng=28.0, removed=False, risk="High"):
    return (i, 1, lng, -26.0, species, risk, removed, T0 + dt.timedelta(minutes=minutes))


def test_status_changes_in_order(spark, tmp_path):
    schema = "sighting_id long, status string, risk_level string, ts timestamp"
    src = replay(spark, tmp_path, [
        [(1, "failed", None, T0)], [(1, "completed", "High", T0 + dt.timedelta(hours=1)), (9, "completed", "Low", T0)], [(2, "other", None, T0)]], schema)
    changes = feeds.run_to_table(feeds.stream_status(src), "append", str(tmp_path / "status"))
    now = {r["sighting_id"]: r["status"] for r in feeds.latest(changes, ["sighting_id"], "ts").collect()}
    assert now == {1: "completed", 9: "completed"}


def test_live_counts_over_batches(spark, tmp_path):
    src = replay(spark, tmp_path, [[sight(1, 0), sight(2, 5, None)], [sight(3, 10), sight(4, 12, removed=True)]], SIGHTING)
    got = {(r["day"], r["species"]): r["n"] for r in feeds.latest(feeds.run_to_table(feeds.stream_live_counts(src), "update", str(tmp_path / "counts")), ["day", "species"]).collect()}
    assert got == {("2024-01-01", "A"): 2, ("2024-01-01", "Unknown"): 1}


def test_repeated_captures_are_dropped(spark, tmp_path):
    schema = "sighting_id long, owner long, image_path string, from_video string, lng string, lat string, predicted_species string, confidence string, created_at timestamp"
    row = (1, 1, "/a.jpg", "true", "oops", "-26", None, "0.5", T0)
    src = replay(spark, tmp_path, [[row, row], [row]], schema)
    out = feeds.run_to_table(feeds.stream_new_sightings(src), "append", str(tmp_path / "new")).collect()
    assert len(out) == 1
    assert (out[0]["lng"], out[0]["lat"], out[0]["predicted_species"], out[0]["llm_status"]) == (0.0, -26.0, "Unknown species", "pending")


def test_cells_follow_removals(spark, tmp_path):
    schema = "sighting_id long, lng double, lat double, created_at timestamp, delta int"
    later = T0 + dt.timedelta(days=2)
    src = replay(spark, tmp_path, [[(1, 28.0, -26.0, T0, 1), (2, 28.0, -26.0, T0, 1)], [(1, 28.0, -26.0, T0, -1)], [(5, 28.0, -26.0, later, 1)]], schema)
    out = feeds.cell_totals(feeds.run_to_table(feeds.stream_removals(src), "update", str(tmp_path / "cells"))).collect()
    assert [r["n"] for r in out] == [2]


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    """Every start sees new files only; counts, totals and batches go on."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    notes, store = str(tmp_path / "notes"), str(tmp_path / "cells")
    for k in range(3):
        spark.createDataFrame([sight(10 * k + i, 60 * k + i) for i in range(2)], SIGHTING).write.mode("append").parquet(source)
        stream = lambda: spark.readStream.schema(SIGHTING).parquet(source)
        changes = feeds.run_to_table(feeds.stream_live_counts(stream()), "update", out)
        feeds.stream_alerts(stream(), store, notes)
    assert [r["n"] for r in feeds.latest(changes, ["day", "species"]).collect()] == [6]
    assert changes.select("batch").distinct().count() >= 3
    totals = spark.read.parquet(store).groupBy("slot").agg(F.sum("n").alias("n")).collect()
    assert max(r["n"] for r in totals) == 6
    titles = [r["title"] for r in spark.read.parquet(notes).collect()]
    assert "Species Concentration Detected" in titles


def test_codes_expire(spark, tmp_path):
    regs = replay(spark, tmp_path / "r", [[("a", T0)]], "code string, ts timestamp")
    uses = replay(spark, tmp_path / "u", [[(1, "a", T0 + dt.timedelta(hours=1)), (2, "a", T0 + dt.timedelta(hours=24)), (3, "b", T0)]], "use_id long, code string, ts timestamp")
    out = feeds.run_to_table(feeds.stream_code_ttl(regs, uses), "append", str(tmp_path / "codes")).collect()
    assert [r["use_id"] for r in out] == [1]


def test_alert_is_raised_once(spark, tmp_path):
    batch = [sight(i, i) for i in range(3)]
    src = replay(spark, tmp_path, [batch, [sight(10, 90, removed=True)]], SIGHTING)
    notes = new_path(spark, "notes")
    feeds.stream_alerts(src, new_path(spark, "cells"), notes)
    titles = [r["title"] for r in spark.read.parquet(notes).collect()]
    assert sorted(titles) == ["Low Detection Activity", "New Invasive Species Detected", "Species Concentration Detected"]


def test_upsert_of_views_is_portable(spark, sf_dir):
    """The sightings view has the canonical columns."""
    from sightline.schemas import SIGHTING as canonical

    assert tb.sightings(spark, sf_dir).columns == [f.name for f in canonical]


def test_no_query_runs_a_cartesian_product(spark, sf_dir):
    from sightline.registry import QUERIES

    batch = sorted(n for n in QUERIES if not n.startswith(("stream_", "src_", "sink_")))
    for name in {"hotspots", "species_stats", "code_session_join", "species_fallback", "photos_per_species", "distance_from_first", *batch[::8]}:
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
