"""The pipeline, stage by stage, against plain versions."""

from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from sightline.llm import ownership
from sightline.llm.queries import read
from test_llm_texts import plain_components, plain_fingerprint, plain_spans
from test_llm_tokens import assert_packed, crc_of, ids_of, plain_targets


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """What goes into every stage and what comes out of the last, stored in between as a driver does."""
    docs = read(spark, sf_dir, "documents")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, out[-1], sf_dir).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_quality_keeps_clean_documents(spark, sf_dir, stages):
    before, after = by_id(stages[0]), by_id(stages[1])
    assert all(before[d] == r for d, r in after.items()) and len(after) < len(before)
    labels = by_id(read(spark, sf_dir, "labels"))
    good = [d for d, r in labels.items() if r.quality == 1 and r.toxic == 0]
    bad = [d for d, r in labels.items() if r.quality == 0]
    assert sum(d in after for d in good) >= 0.98 * len(good) and sum(d in after for d in bad) <= 0.2 * len(bad)


def test_one_document_of_each_group_stays(stages):
    before = by_id(stages[1])
    want = {d for d, _, c in plain_components([(d, plain_fingerprint(r.text, 5)) for d, r in before.items()]) if d == c}
    assert {d: before[d] for d in want} == by_id(stages[2])


def test_live_secrets_go(stages):
    before, after = by_id(stages[2]), by_id(stages[3])
    owners = defaultdict(set)
    for r in before.values():
        for *_, value in plain_spans(r.text):
            owners[value].add(r.source)
    import re

    for d, r in before.items():
        text, at, parts = r.text, 0, []
        live = sorted((end - len(v), end) for _, _, _, end, v in plain_spans(text)
                      if len(owners[v]) == 1 and not re.search(ownership.PLACEHOLDER, v) and len(re.findall("[0-9]", v)) >= 2)
        for a, b in live:
            if not at or a > at:
                parts += [text[at:a], "[SECRET]"]
            at = max(at, b)
        assert after[d].text == "".join(parts) + text[at:] and after[d].n_chars == (len(after[d].text) if live else r.n_chars)
    assert before.keys() == after.keys()


def test_mix(stages):
    sizes, taken, longest = Counter(), Counter(), Counter()
    for r in stages[3].collect():
        n = len(r.text.split())
        sizes[r.source] += n
        longest[r.source] = max(longest[r.source], n)
    rows = stages[4].collect()
    often = Counter(r.doc_id for r in rows)
    assert max(often.values()) <= 3 and stages[4].columns == stages[3].columns
    for r in rows:
        taken[r.source] += len(r.text.split())
    target = plain_targets(sizes)
    assert all(abs(taken[s] - target[s]) <= longest[s] / 2 + 1e-6 for s in sizes)


def test_everything_is_packed(stages):
    rows = stages[5].collect()
    want = Counter()
    for r in stages[4].collect():
        ids = [*ids_of(r.text), 0]
        first = len(ids) % 2048 or min(len(ids), 2048)
        cuts = [0, *range(first, len(ids), 2048), len(ids)]
        want.update((r.doc_id, k, a, b - a, crc_of(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = assert_packed(rows, 2048)
    assert bins <= 1.02 * sum(r.length for r in rows) / 2048 + 2


def test_stages_take_odd_rows(spark, sf_dir):
    names = "doc_id long, text string, lang string, source string, n_chars long, copies int, row int, kind string, spans string, keep int, fp int"
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "x " * 30_000, "en", "a", 60_000), (4, "token = abcdefgh935176", "en", None, 23), (4, "token = abcdefgh935176", "en", None, 23), (None, "no id", "en", "b", 5)]
    docs = spark.createDataFrame([(*r, 1, 2, "k", "s", 1, 3) for r in rows], names)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
        assert stage(spark, docs, sf_dir).count() <= 3 * len(rows)
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    kept = corpus_pipeline.near_duplicates(spark, docs, sf_dir).select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == [1, 3, 4]
    assert corpus_pipeline.secrets(spark, docs, sf_dir).where(F.col("text") == "token = [SECRET]").count() == 2
    assert corpus_pipeline.packed(spark, docs, sf_dir).where("doc_id = 4").count() == 2
