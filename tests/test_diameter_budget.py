"""Budgets of cell pairs, and the newest scientific name."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from sightline.operators import diameter, threat


def test_one_crowded_pair_is_split(spark, monkeypatch):
    """Two towns at the ends of a line: one pair of cells would hold all the work; each measured pair keeps its budget."""
    rng = np.random.default_rng(1)
    towns = [(28.0, -26.0)] * 600 + [(28.9, -25.1)] * 600
    rows = [("a", float(x + rng.normal() * 0.01), float(y + rng.normal() * 0.01)) for x, y in towns]
    rows += [("b", 1.0, 2.0)]
    seen, spans = [], diameter._spans

    def watched(pairs, placed, by):
        seen.append(pairs.agg(F.count("*"), F.max(F.col("n_a") * F.col("n_b")), F.max(F.col("n_a") + F.col("n_b"))).first())
        return spans(pairs, placed, by)

    monkeypatch.setattr(diameter, "_spans", watched)
    monkeypatch.setattr(diameter, "_DIRECT_PAIRS", 100)
    got = {r.species: r.diameter_km for r in diameter.farthest_pair(spark.createDataFrame(rows, "species string, lng double, lat double"), "species").collect()}
    p = np.radians(np.array([r[1:] for r in rows[:-1]]))
    d = np.sin((p[:, None, 1] - p[None, :, 1]) / 2) ** 2 + np.cos(p[:, None, 1]) * np.cos(p[None, :, 1]) * np.sin((p[:, None, 0] - p[None, :, 0]) / 2) ** 2
    assert abs(got["a"] - 2 * 6371 * np.arcsin(np.sqrt(d.max()))) < 1e-6 and got["b"] == 0
    assert len(seen) > 1 and all(most is None or most <= max(100, 16 * points) for _, most, points in seen)
    assert sum(n for n, *_ in seen) > 1  # several pairs, so several tasks can share them


def test_newest_scientific_name(spark):
    t = dt.datetime(2024, 1, 1)
    names = "sighting_id long, predicted_species string, scientific_name string, created_at timestamp, lng double, lat double, is_removed boolean, confidence double, image_path string, risk_level string"
    rows = [(1, "A", "Old name", t, 1.0, 1.0, False, 0.5, None, None), (2, "A", "New name", t + dt.timedelta(1), 1.0, 1.0, False, 0.5, None, None),
            (3, "A", "", t + dt.timedelta(2), 1.0, 1.0, False, 0.5, None, None), (4, "A", "Gone", t + dt.timedelta(3), 1.0, 1.0, True, 0.5, None, None), (5, "B", None, t, 1.0, 1.0, False, 0.5, None, None)]
    s = spark.createDataFrame(rows, names)
    assert {r.species: r.scientific_name for r in threat.species_stats(s).collect()} == {"A": "New name", "B": ""}
    assert {r.scientific_name for r in threat.species_stats(s.drop("scientific_name")).collect()} == {""}
