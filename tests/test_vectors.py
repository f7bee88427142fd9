"""The metric index against all distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.operators import vectors

KINDS = "vec_id long, embedding array<float>, cell int, near double"


def clustered(n, seed, dim=6, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim)) * 5
    rows = [(i, [float(np.float32(x)) for x in centres[i % 12] + rng.normal(size=dim) * 0.3], 1, 2.0) for i in range(n)]
    return rows + [(n + i, rows[0][1], 1, 2.0) for i in range(copies)]


def plain(queries, rows, k, metric, most=float("inf")):
    out = []
    for query_id, q, *_ in queries:
        q = np.array(q, dtype="float64")
        scored = []
        for vec_id, v, *_ in rows:
            v = np.array(v, dtype="float64")
            d = 1 - (v / np.linalg.norm(v)) @ (q / np.linalg.norm(q)) if metric == "cosine" else ((v - q) ** 2).sum()
            scored.append((round(float(d), 9), vec_id))
        out += [(query_id, rank, vec_id) for rank, (d, vec_id) in enumerate(sorted(scored)[:k], 1) if d <= most]
    return sorted(out)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize(("tile", "k"), [(8, 3), (8, 40), (4096, 3)])
def test_metric_index(spark, metric, tile, k):
    rows = clustered(300, 1, copies=60 if k == 3 else 0)
    asked = clustered(25, 2) + [(999, rows[0][1], 1, 2.0)]
    queries = spark.createDataFrame(asked, KINDS).withColumnRenamed("vec_id", "query_id")
    table = spark.createDataFrame(rows, KINDS).repartition(3)
    got = vectors.knn(queries, table, k, metric, tile=tile)
    if metric == "l2":
        assert sorted((r.query_id, r.rank, r.vec_id) for r in got.collect()) == plain(asked, rows, k, metric)
    else:  # equal but for the last digit: compare the distances
        want = {(q, r): v for q, r, v in plain(asked, rows, k, metric)}
        by_id = {i: np.array(v) / np.linalg.norm(v) for i, v, *_ in rows}
        of = {i: np.array(v) / np.linalg.norm(v) for i, v, *_ in asked}
        found = got.collect()
        assert len(found) == len(want)
        assert all(abs(r.distance - (1 - by_id[want[r.query_id, r.rank]] @ of[r.query_id])) < 1e-7 for r in found)


def test_far_rings_are_not_joined(spark):
    """Counts the vectors that queries meet: most cells and rings are left out by the triangle inequality."""
    rows = clustered(1200, 3)
    index = vectors.metric_index(spark.createDataFrame(rows, KINDS), centres=24, tile=10)
    assert index.directory.count() > 24 and index.directory.agg(F.sum("n")).first()[0] == 1200
    queries = spark.createDataFrame(clustered(40, 4), KINDS).withColumnRenamed("vec_id", "query_id")
    given = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"), F.lit(float("inf")).alias("reach"), F.lit(-1).alias("first_cell"), F.lit(-1).cast("long").alias("first_ring"))
    start = vectors.first_rings(index, given)
    found = vectors.nearest(index, queries, 3).where("rank = 3").select("query_id", F.sqrt("distance").alias("reach"))
    bounded = given.drop("reach", "first_cell", "first_ring").join(found, "query_id").join(start.select("query_id", F.col("cell").alias("first_cell"), F.col("ring").alias("first_ring")), "query_id")
    met = vectors.other_rings(index, bounded).agg(F.sum("n")).first()[0] or 0
    first = start.agg(F.sum("n"), F.count("*")).first()
    assert first[1] == 40 and met + first[0] <= 0.25 * 40 * 1200


def test_one_vector_a_third_of_the_time(spark):
    rows = clustered(100, 5, copies=50)
    table = spark.createDataFrame(rows, KINDS)
    index = vectors.metric_index(table, tile=8)
    crowded = index.directory.orderBy(F.desc("n")).first()
    assert crowded.n > 8  # such a ring is several tiles
    queries = spark.createDataFrame([(1, rows[0][1])], "query_id long, embedding array<float>")
    got = vectors.nearest(index, queries, 51).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank)][:51] == [0, *range(100, 150)]


def test_empty_tables_and_missing_vectors(spark):
    table = spark.createDataFrame([(1, [0.0, 1.0], 0, 0.0), (2, None, 0, 0.0)], KINDS)
    queries = spark.createDataFrame([(7, None), (8, [0.0, 2.0])], "query_id long, embedding array<double>")
    assert [tuple(r) for r in vectors.knn(queries, table, 4).collect()] == [(8, 1, 1.0, 1)]
    assert vectors.knn(queries, table.limit(0), 4).count() == 0
    assert vectors.knn(queries.limit(0), table, 4).count() == 0
