"""Predicates, risk rules, lookups, updates and alerts on literal rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sightline.functions import arrays as ar, risk as rk, times as tm
from sightline.operators import advisory as adv, alerts, curation as c, predicates as p, scoring, temporal, threat, updates, vectors
from sightline.registry.guide import kb

def as_of():
    return F.to_timestamp(F.lit("2024-01-30 12:00:00"))


def column(spark, values, fn, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r["r"] for r in rows.select("i", fn(F.col("c")).alias("r")).orderBy("i").collect()]


SPECIES = ["Acacia", "Unknown", "Unknown species", "Unknown_Plant", "", None]


def test_three_invasive_tests(spark):
    assert column(spark, SPECIES, p.is_invasive_named) == [True, False, False, False, False, False]
    assert column(spark, SPECIES, p.is_invasive_truthy) == [True, False, False, True, False, False]
    assert column(spark, SPECIES, p.is_invasive_loose) == [True, False, True, True, False, False]


def test_risk(spark):
    levels = ["High", "Severe", "Moderate", "minimal", None, "odd"]
    assert column(spark, levels, rk.risk_band) == ["high", "high", "medium", "low", "unknown", "unknown"]
    assert column(spark, levels, rk.risk_is_high) == [True, True, False, False, False, False]


def test_binomial(spark):
    names = ["Testus primus", "Badus Nomen", "Where found", "Acacia", "acacia mearnsii", "Acacia me", None, "Acacia mearnsii extra"]
    assert column(spark, names, p.looks_like_binomial) == [True, False, False, False, False, False, False, False]


def test_species_shape(spark):
    names = ["Acacia mearnsii x", "Table of contents", "acacia m", "Acacia", None]
    assert column(spark, names, p.looks_like_species) == [True, False, False, False, False]


def test_codes(spark):
    assert column(spark, ["123456", "12345", "123456\n", "12345a", None], p.valid_code) == [True, False, False, False, False]


def test_normalise_prediction(spark):
    df = spark.createDataFrame([("Acacia_x", "0.5"), ("undefined", "oops"), (None, None), ("null", "NaN")], "predicted_species string, confidence string")
    got = [tuple(r) for r in p.normalise_prediction(df).select("predicted_species", "lookup_name", "confidence").collect()]
    assert got == [("Acacia_x", "Acacia x", 0.5)] + [("Unknown species", "Unknown species", 0.0)] * 3


def test_age_color(spark):
    now = dt.datetime(2024, 1, 30, 12)
    ages = [now + dt.timedelta(days=1), now - dt.timedelta(days=15), now - dt.timedelta(days=30), None]
    got = column(spark, ages, lambda x: rk.age_color(x, as_of()), "timestamp")
    assert got == ["#FFD700", "rgb(255, 142, 34)", "#FF4444", "#FFD700"]


def test_seasons(spark):
    stamps = [dt.datetime(2024, m, 5) for m in range(1, 13)]
    north = column(spark, stamps, tm.season, "timestamp")
    assert north == ["Winter"] * 2 + ["Spring"] * 3 + ["Summer"] * 3 + ["Fall"] * 3 + ["Winter"]
    south = column(spark, stamps, lambda x: tm.season(x, "south"), "timestamp")
    assert south[0] == "Summer" and south[6] == "Winter"
    assert column(spark, stamps[:1], tm.week_key, "timestamp") == ["2023-12-31"]


def test_texts(spark):
    df = spark.createDataFrame([("high", 6, 2), ("medium", 2, 0), ("low", 1, 1), ("low", 0, 0)], "l string, n int, r int")
    got = [x["t"] for x in df.select(rk.recommendation_text(F.col("l"), F.col("n"), F.col("r")).alias("t")).collect()]
    assert got[0].endswith("Immediate intervention required. Great job removing 2 plants today!")
    assert got[2].endswith("Great job removing 1 plant today!")
    assert got[3] == "No new invasive species detected today. Maintain vigilance."
    rates = column(spark, [31.0, 16.0, 15.0], rk.spread_trend, "double")
    assert rates == ["↗ Rapid expansion", "→ Moderate spread", "↘ Slow spread"]


def test_removal_trend(spark):
    df = spark.createDataFrame([(0, 0), (2, 2), (3, 1), (1, 3)], "a int, b int")
    assert [r["t"] for r in df.select(rk.removal_trend(F.col("a"), F.col("b")).alias("t")).collect()] == [
        "→ No activity", "→ Same as yesterday", "↗ +2 from yesterday", "↘ -2 from yesterday"]


@pytest.mark.parametrize("n, severity, score", [(0, "Minimal", 0.0), (1, "Low", 4.2), (5, "Moderate", 21.0), (10, "High", 42.0), (20, "Critical", 84.0), (30, "Critical", 100.0)])
def test_impact(spark, n, severity, score):
    r = threat.environmental_impact(spark.createDataFrame([(n, 1)], "active_invasives long, new_today long")).first()
    assert r["severity"] == severity and r["risk_score"] == pytest.approx(score)
    assert r["daily_trend"] == "New environmental threat detected"


def test_softmax(spark):
    r = spark.range(1).select(ar.softmax(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))).alias("s"), ar.argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0))).alias("a")).first()
    assert [round(x, 6) for x in r["s"]] == [0.090031, 0.244728, 0.665241] and r["a"] == 1


def test_metrics_first_best_epoch(spark):
    rows = [(1, [0.0, 1.0], 0), (2, [1.0, 0.0], 0), (3, [1.0, 0.0], 0)]
    m = {r["epoch"]: r for r in scoring.classification_metrics(spark.createDataFrame(rows, "epoch int, logits array<double>, label int")).collect()}
    assert [m[e]["best"] for e in (1, 2, 3)] == [False, True, False]
    assert m[1]["accuracy"] == 0.0 and m[2]["accuracy"] == 100.0


def test_legal_ladder(spark):
    texts = ["Eradicate on sight", "Cut and paint stumps", "Needs a permit", "Keep inside gardens", "Not found", None, "Remove; a permit helps"]
    assert column(spark, texts, adv.legal_category) == ["1a", "1b", "2", "3", "Unknown", "Unknown", "1b"]


def test_fallback(spark):
    df = spark.createDataFrame([("Acacia_mearnsii",), ("Acacia_melanoxylon",), ("Zzz_absent",), ("Rosa alba",)], "lookup_name string")
    taxonomy = spark.createDataFrame([("Rosa", "Rosaceae")], "genus string, family string")
    got = {r["lookup_name"]: r for r in adv.species_fallback(df, kb(spark), taxonomy).collect()}
    assert [got[n]["generalisation_level"] for n in ("Acacia_mearnsii", "Acacia_melanoxylon", "Zzz_absent", "Rosa alba")] == ["exact", "genus", "none", "family"]
    assert got["Acacia_melanoxylon"]["disclaimer"] == (
        "This advisory is based on Acacia dealbata characteristics as no specific data exists for Acacia melanoxylon")


@pytest.mark.parametrize("conf, level, action", [
    (0.81, "High confidence detection", "Immediate action recommended"), (0.8, "Moderate confidence detection", "Further verification recommended"),
    (0.6, "Low confidence detection", "Manual verification required"), (None, "Low confidence detection", "Manual verification required")])
def test_confidence_edges(spark, conf, level, action):
    s = spark.createDataFrame([("Acacia_mearnsii", conf)], "predicted_species string, confidence double")
    a = adv.sighting_advisory(s, kb(spark)).first()["advisory"]
    assert (a["confidence_level"], a["action_required"], a["risk_level"]) == (level, action, "High")
    assert a["advisory_content"]["legal_status"]["legal_requirements"] == "Category 1a species - Immediate removal required"


def test_advice_has_the_canonical_shape(spark):
    from sightline.schemas import ADVISORY_CONTENT

    s = spark.createDataFrame([("Acacia_mearnsii", 0.9)], "predicted_species string, confidence double")
    content = adv.sighting_advisory(s, kb(spark)).schema["advisory"].dataType["advisory_content"].dataType
    shape = lambda t: [(f.name, shape(f.dataType) if hasattr(f.dataType, "fields") else f.dataType) for f in t.fields]
    assert shape(content) == shape(ADVISORY_CONTENT)


def test_unknown_species_advice(spark):
    s = spark.createDataFrame([("Zzz", 0.9)], "predicted_species string, confidence double")
    a = adv.sighting_advisory(s, kb(spark)).first()["advisory"]
    assert a["classification"] == "unknown" and a["data_sources"] == [] and a["generalisation_level"] == "none"


NOTES = "id string, type string, title string, description string, level string, dismissed boolean"


def test_notifications(spark):
    notes = spark.createDataFrame([
        ("1", "risk", "T", "D", "critical", False), ("2", "risk", "U", "D", "critical", True), ("3", "weather", "W", "D", "info", False),
        ("4", "risk", "V", "D", "warning", False)], NOTES)
    new = spark.createDataFrame([("critical", "T", "D"), ("critical", "U", "D")], "level string, title string, description string")
    assert [r["title"] for r in alerts.alerts_new(new, notes).collect()] == ["U"]
    done = spark.createDataFrame([("4",)], "id string")
    feed = [(r["rank"], r["title"]) for r in alerts.alert_feed(new, notes, done).collect()]
    assert feed == [(1, "W"), (4, "T"), (4, "U")]
    badge = alerts.notification_badges(notes).first()
    assert (badge["risk"], badge["weather"], badge["total"], badge["badge"]) == (2, 1, 3, "danger")


def test_code_sessions(spark):
    h = lambda x: dt.datetime(2024, 1, 1) + dt.timedelta(hours=x)
    regs = spark.createDataFrame([("a", h(0)), ("a", h(1)), ("b", h(0))], "code string, ts timestamp")
    uses = spark.createDataFrame([(1, "a", h(0.5)), (2, "a", h(24.9)), (3, "a", h(25)), (4, "b", h(23.9)), (5, "b", h(24)), (6, "c", h(1)), (7, "a", h(0))],
                                 "use_id long, code string, ts timestamp")
    got = {r["use_id"]: r["registered_at"] for r in updates.code_session_join(regs, uses).collect()}
    assert got == {1: h(0), 2: h(1), 4: h(0), 7: h(0)}


def test_mark_removed(spark):
    s = spark.createDataFrame([(1, 7, False, None, None), (2, 8, False, None, None)],
                              "sighting_id long, owner long, is_removed boolean, removed_at timestamp, removed_by string")
    r = spark.createDataFrame([(1, 7, None, None), (1, 7, None, None), (2, 9, None, None)], "sighting_id long, owner long, removed_at timestamp, removed_by string")
    got = {x["sighting_id"]: x for x in updates.mark_removed(s, r, as_of()).collect()}
    assert updates.mark_removed(s, r, as_of()).count() == 2
    assert got[1]["is_removed"] and got[1]["removed_by"] == "user" and not got[2]["is_removed"]
    assert updates.removals_not_found(s, r).count() == 1


def test_repeated_results_change_a_sighting_once(spark):
    s = spark.createDataFrame([(1, "pending", None), (2, "pending", "Low")], "sighting_id long, llm_status string, risk_level string")
    r = spark.createDataFrame([(1, "completed", "High", 2), (1, "failed", None, 1), (1, "completed", "High", 2)], "sighting_id long, status string, risk_level string, ts int")
    got = sorted((x["sighting_id"], x["llm_status"], x["risk_level"]) for x in updates.apply_analysis(s, r, "ts").collect())
    assert got == [(1, "completed", "High"), (2, "pending", "Low")]


def test_audit(spark):
    counts = spark.createDataFrame([("a", 0), ("b", 5), ("c", 9), ("d", 10), ("e", 200), ("f", 201), ("observation_1", 3)], "class_name string, n long")
    a = c.dataset_audit(counts).first()
    assert (a["images"], a["folders"], a["median_size"], a["small"], a["large"], a["observation_folders"]) == (428, 7, 9, 3, 1, 1)
    even = c.dataset_audit(counts.where("class_name <> 'a'")).first()
    assert even["median_size"] == 10
    assert {r["class_name"] for r in c.below_min_classes(counts, 5).collect()} == {"a"}
    assert [r["advice_no"] for r in c.audit_advice(c.dataset_audit(counts)).collect()] == [2, 3, 4]


def test_sample_does_not_depend_on_partitions(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("species"))
    a = c.sample_per_group(df.repartition(3), "species", "id", 20).collect()
    b = c.sample_per_group(df.repartition(11), "species", "id", 20).collect()
    assert sorted(a) == sorted(b) and len(a) == 20 * 8


def test_samples_are_cut_before_the_shuffle(spark, sf_dir):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("g"))
    plan = c.sample_per_group(df, "g", "id", 5)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    # plans print from the result down: the partial limit stands below the exchange
    assert physical.index("Exchange") < physical.index("WindowGroupLimit", physical.index("Exchange"))


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_knn_ways_agree(spark, metric):
    import numpy as np
    rng = np.random.default_rng(0)
    v = [(i, rng.normal(size=8).tolist()) for i in range(200)]
    q = [(1000 + i, rng.normal(size=8).tolist()) for i in range(30)]
    vectors_df = spark.createDataFrame(v, "vec_id long, embedding array<double>").repartition(4)
    queries = spark.createDataFrame(q, "query_id long, embedding array<double>")
    small = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in vectors.knn(queries, vectors_df, 3, metric).collect())
    tiled = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in vectors.knn(queries, vectors_df, 3, metric, small_values=0).collect())
    def dist(a, b):
        a, b = np.array(a), np.array(b)
        return ((a - b) ** 2).sum() if metric == "l2" else 1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    want = sorted((qi, k + 1, vi) for qi, x in q for k, (_, vi) in enumerate(sorted((dist(x, y), i) for i, y in v)[:3]))
    assert small == tiled == want


def test_knn_threshold_and_empty(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(9, [0.0, 0.0])], "query_id long, embedding array<double>")
    assert [r["vec_id"] for r in vectors.knn(q, v, 2, max_distance=1.0).collect()] == [1]
    assert vectors.knn(q.limit(0), v, 2).count() == 0


def test_avg_risk(spark):
    df = spark.createDataFrame([(10, 6, 0), (10, 5, 4), (10, 5, 3)], "n int, h int, m int")
    assert [r["r"] for r in df.select(temporal.avg_risk(F.col("n"), F.col("h"), F.col("m")).alias("r")).collect()] == ["High", "Medium", "Low"]


def test_empty_sightings(spark, sf_dir):
    """Empty input gives zero counts, not failures."""
    from sightline.operators import spatial
    from sightline.sources import tables as tb

    s = tb.sightings(spark, sf_dir).where("false")
    assert spatial.hotspots(s).count() == 0
    assert spatial.coverage_stats(s).first()["total_area"] == 0.0
    assert spatial.density_summary(s).first()["cells"] == 0
    assert spatial.species_diameter(s).count() == 0
    assert temporal.peak_hour(s).first()["peak_hour"] == 0
    assert threat.invasive_daily(s, as_of()).first()["threat_level"] == "low"
    assert [r["level"] for r in alerts.risk_alerts(s, as_of()).collect()] == ["info"]
