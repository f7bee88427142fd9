"""Keyed state of streams: one change per transition, one alert per type and day, also after a restart."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sightline.operators.alerts import once_per_day
from sightline.streaming import feeds
from test_sources_streams import SIGHTING, T0, sight

RESULTS = "sighting_id long, status string, risk_level string, ts timestamp"
ALERTS = "type string, alert_id long, raised_at timestamp, dismissed boolean"


def hours(n):
    return T0 + dt.timedelta(hours=n)


def slices(spark, tmp_path, batches, schema, build):
    """Every batch is a new start of the stream on the same folders."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        changes = feeds.run_to_table(build(spark.readStream.schema(schema).parquet(source)), "append", out)
    return changes.orderBy("batch").collect()


def test_one_change_per_transition(spark, tmp_path):
    batches = [
        [(1, "completed", "High", hours(2)), (2, "failed", None, hours(2)), (3, "failed", None, hours(1)), (3, "completed", "Low", hours(3)), (4, "pending", None, hours(1)), (None, "completed", "Low", hours(1))],
        [(1, "completed", "High", hours(2)), (1, "completed", "High", hours(5)), (1, "failed", None, hours(1)), (2, "failed", None, hours(4)), (5, "completed", "Low", None)],
        [(2, "completed", "Low", hours(6)), (3, "failed", None, hours(2)), (5, "completed", "Low", hours(0))],
    ]
    got = slices(spark, tmp_path, batches, RESULTS, feeds.stream_status)
    seen = {}
    for r in got:
        seen.setdefault(r.sighting_id, []).append((r.status, r.risk_level, r.ts, r.event))
    assert seen == {
        1: [("completed", "High", hours(2), "analysis_done")],
        2: [("failed", None, hours(2), None), ("completed", "Low", hours(6), "analysis_done")],
        3: [("completed", "Low", hours(3), "analysis_done")],
        5: [("completed", "Low", None, "analysis_done")],
    }


def test_one_alert_per_type_and_day(spark, tmp_path):
    batches = [
        [("weather", 2, hours(1), False), ("weather", 1, hours(2), False), ("risk", 3, hours(1), None), (None, 4, hours(1), False), ("risk", 5, None, False)],
        [("weather", 6, hours(3), False), ("risk", 7, hours(3), False), ("weather", 8, hours(20), False)],
        [("weather", 2, hours(4), True)],
        [("weather", 9, hours(5), False), ("weather", 10, hours(6), False), ("risk", 3, T0 - dt.timedelta(days=9), True)],
    ]
    got = slices(spark, tmp_path, batches, ALERTS, feeds.stream_daily_alerts)
    assert sorted((r.type, r.day, r.alert_id) for r in got) == [("risk", "2024-01-01", 3), ("weather", "2024-01-01", 2), ("weather", "2024-01-01", 9), ("weather", "2024-01-02", 8)]


def run_alerts(spark, tmp_path, rows):
    spark.createDataFrame(rows, SIGHTING).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    feeds.stream_alerts(spark.readStream.schema(SIGHTING).parquet(str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "notes"))


def test_alerts_of_a_title_come_once_a_day(spark, tmp_path):
    """The second slice changes the number in the text, not the kind of alert; the third is of the next day."""
    for k, minutes in enumerate((0, 60, 26 * 60)):
        run_alerts(spark, tmp_path, [sight(10 * k + i, minutes + i) for i in range(3 + k)])
    notes = spark.read.parquet(str(tmp_path / "notes"))
    days = notes.groupBy("title", F.to_date("raised_at").alias("day")).count().collect()
    assert all(r["count"] == 1 for r in days) and len({r.day for r in days}) == 2
    texts = {r.description for r in notes.where("title = 'New Invasive Species Detected'").collect()}
    assert len(texts) == 2


def test_dismissed_notifications_do_not_stand(spark):
    note = "title string, description string, dismissed boolean, raised_at timestamp"
    stored = spark.createDataFrame([("a", "1", False, hours(0)), ("b", "1", True, hours(0)), ("c", "1", False, hours(-24))], note)
    raised = spark.createDataFrame([(t, "2", False, hours(1)) for t in "abcd"], note)
    assert sorted(r.title for r in once_per_day(raised, stored).collect()) == ["b", "c", "d"]


def test_a_lost_store_is_an_error(spark, tmp_path):
    """Totals that have gone are not taken for a first start."""
    run_alerts(spark, tmp_path, [sight(1, 0)])
    for name in ("slot=0", "slot=1"):
        if (tmp_path / "store" / name).exists():
            (tmp_path / "store" / name).rename(tmp_path / f"away-{name}")
    with pytest.raises(PySparkException):
        run_alerts(spark, tmp_path, [sight(2, 1)])
