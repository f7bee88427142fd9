"""The advice cascade and the two steps of timelines."""

import datetime as dt

from pyspark.sql import functions as F

from sightline.functions.text import letter_counts
from sightline.operators import advisory, temporal
from sightline.registry import QUERIES
from sightline.registry.guide import kb

TAXONOMY = "SELECT 'Rosa' AS genus, 'Rosaceae' AS family"


def test_every_step_of_the_cascade(spark):
    names = ["Acacia mearnsii", "gamma SHRUB ", "Acacia melanoxylon", "Rosa alba", "Lantama camara", "Zzz absent", None, "Lantama camara"]
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(names)], "id long, lookup_name string, used string")
    got = {r.id: (r.generalisation_level, r.used_species) for r in advisory.cascade(df, kb(spark), spark.sql(TAXONOMY), letter_counts, 3.0).collect()}
    assert got == {
        0: ("exact", "Acacia mearnsii"), 1: ("exact", "Lantana camara"), 2: ("genus", "Acacia dealbata"), 3: ("family", "Nullus planus"),
        4: ("similar", "Lantana camara"), 5: ("none", None), 6: ("none", None), 7: ("similar", "Lantana camara")}
    plain = {r.id: r.generalisation_level for r in advisory.cascade(df, kb(spark), spark.sql(TAXONOMY)).collect()}
    assert plain[4] == "none" and plain[3] == "family"
    assert advisory.cascade(df.limit(0), kb(spark), None, letter_counts, 3.0).count() == 0


def test_the_query_meets_all_levels(spark, sf_dir):
    levels = {r.generalisation_level for r in QUERIES["advise_relatives"](spark, sf_dir).select("generalisation_level").distinct().collect()}
    assert levels == {"exact", "genus", "family", "similar", "none"}


def test_species_of_dropped_periods_are_not_gathered(spark, monkeypatch):
    rows = [(i, f"Species_{i % 9}", dt.datetime(2024, 1 + i % 10, 1 + i % 20), False, "High") for i in range(400)] + [(400, "Lost_one", None, False, None)]
    s = spark.createDataFrame(rows, "sighting_id long, predicted_species string, created_at timestamp, is_removed boolean, risk_level string")
    got = {r.period: (r.n, r.species) for r in temporal.timeline_all(s, "monthly", 2).collect()}
    assert sorted(got) == ["2024-09", "2024-10"]
    for period, (n, species) in got.items():
        own = [r for r in rows if r[2] and r[2].month == int(period[-2:])]
        newest = {}
        for r in own:
            newest[r[1]] = min(newest.get(r[1], (0, 0)), (-r[2].timestamp(), r[0]))
        assert n == len(own) and species == ", ".join(sorted(newest, key=newest.get)[:2])
    stored, cut = [], temporal.cut

    def watched(df):
        stored.append(cut(df))
        return stored[-1]

    monkeypatch.setattr(temporal, "cut", watched)
    out = temporal.timeline_all(s, "weekly", 3)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan.split("collect_list")[1] and stored[1].count() == 3  # lists are made after the join with the chosen periods
    assert out.select(F.max(F.size(F.split("species", ", ")))).first()[0] <= 3
