"""Repeats of a name go before names are sorted, and the first spelling stays in its place."""

from pyspark.sql import functions as F

from sightline.functions import arrays


def test_repeats_go_before_the_sort(spark):
    words = ["b", None, "A", "a", "B", "", "a", "b", "É", "é", None]
    got = spark.createDataFrame([(words, 1), ([], 2), (None, 3), ([None], 4)], "w array<string>, id int").select(
        "id", arrays.ordered_name_union(F.col("w"), F.transform("w", F.lower)).alias("n"))
    assert {r.id: r.n for r in got.collect()} == {1: ["b", "A", "", "É"], 2: [], 3: [], 4: []}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct" in plan and "lambdafunction(if" not in plan  # no comparator is called for every pair
