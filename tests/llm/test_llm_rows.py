"""The pipeline's filters go by row: rows without an id, and unrelated texts with one id, are documents like others."""

import corpus_pipeline
from sightline.llm.queries import read
from pyspark.sql import functions as F


def test_quality_goes_by_row(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    kept = corpus_pipeline.quality(spark, docs, sf_dir)
    bad = docs.join(kept, "doc_id", "left_anti")
    good = kept.join(labels, "doc_id", "left_anti").orderBy("doc_id").limit(20)  # the fit reads none of these
    low = bad.join(labels, "doc_id", "left_anti").orderBy("doc_id").limit(5)
    assert good.count() and low.count()
    lost = good.select("doc_id").union(low.select("doc_id"))
    others = docs.join(lost, "doc_id", "left_anti")
    odd = good.withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType)).union(low.withColumn("doc_id", F.lit(10**6).cast(docs.schema["doc_id"].dataType)))
    one_id = good.withColumn("doc_id", F.lit(10**6).cast(docs.schema["doc_id"].dataType))
    after = corpus_pipeline.quality(spark, others.union(odd).union(one_id), sf_dir)
    texts = lambda df: {r.text for r in df.select("text").collect()}
    assert texts(good) <= texts(after.where("doc_id IS NULL"))
    assert texts(good) <= texts(after.where(f"doc_id = {10**6}"))
    assert not (texts(low) - texts(others)) & texts(after)


def test_near_duplicates_and_mixture_go_by_row(spark, sf_dir):
    names = "doc_id long, text string, lang string, source string, n_chars long"
    text = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcdef"]
    rows = [(None, text[0]), (None, text[1]), (7, text[2]), (7, text[3]), (8, text[4]), (None, text[4]), (9, text[5]), (9, text[5])]
    docs = spark.createDataFrame([(d, t, "en", "a", 1) for d, t in rows], names)
    order = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    want = sorted([(None, text[0]), (None, text[1]), (7, text[2]), (7, text[3]), (8, text[4]), (9, text[5])], key=str)
    assert order(corpus_pipeline.near_duplicates(spark, docs, sf_dir)) == want
    assert order(corpus_pipeline.mixture(spark, docs, sf_dir)) == sorted(rows, key=str)  # one source takes each row once


def test_secrets_of_two_sources_go(spark, sf_dir):
    names = "doc_id long, text string, lang string, source string, n_chars long"
    two, three = "token = abcdefgh935176", "token = qrstuvwx846287"
    rows = [(1, f"one {two}", "a"), (2, f"other {two}", "b"), *((3 + i, f"{s} {three}", s) for i, s in enumerate("abc")), (6, "token = your_example_1234567", "a")]
    docs = spark.createDataFrame([(d, t, "en", s, len(t)) for d, t, s in rows], names)
    after = {r.doc_id: r.text for r in corpus_pipeline.secrets(spark, docs, sf_dir).collect()}
    assert after == {1: "one token = [SECRET]", 2: "other token = [SECRET]", **{d: t for d, t, _ in rows[2:]}}
