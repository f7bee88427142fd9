"""Changes that come days after their sighting still count."""

import datetime as dt

from sightline.streaming import feeds
from test_sources_streams import T0, replay

SCHEMA = "sighting_id long, lng double, lat double, created_at timestamp, delta int"


def at(days):
    return T0 + dt.timedelta(days=days)


def test_late_removals_and_rows_without_a_time(spark, tmp_path):
    batches = [[(1, 28.0, -26.0, T0, 1), (2, 28.0, -26.0, T0, 1)], [(3, 28.0, -26.0, at(5), 1)], [(4, 28.0, -26.0, at(6), 1)], [(1, 28.0, -26.0, T0, -1), (5, 28.0, -26.0, None, 1)]]
    src = replay(spark, tmp_path, batches, SCHEMA)
    out = feeds.cell_totals(feeds.run_to_table(feeds.stream_removals(src), "update", str(tmp_path / "cells"))).collect()
    assert [r["n"] for r in out] == [4]


def test_late_sightings_have_markers(spark, tmp_path):
    batches = [[(1, 28.0, -26.0, at(5), 1)], [(2, 28.0, -26.0, at(6), 1)], [(3, 28.0, -26.0, T0, 1), (4, 28.0, -26.0, None, 1)]]
    src = replay(spark, tmp_path, batches, SCHEMA)
    out = feeds.marker_cells(feeds.run_to_table(feeds.stream_marker_cells(src), "update", str(tmp_path / "cells"))).collect()
    assert [(r["n"], r["newest_id"]) for r in out] == [(4, 2)]
