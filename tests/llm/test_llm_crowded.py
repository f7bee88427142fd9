"""Large groups of near copies: pairs that are settled, and the groups against all pairs of texts."""

import random

import corpus_pipeline
import pytest
from sightline.llm import shingles
from test_llm_shingles import NAMES, edited, plain_kept


@pytest.fixture
def asked(monkeypatch):
    """How many pairs each call of ``settled`` got."""
    counts, settled = [], shingles.settled

    def counted(pairs, texts, words):
        counts.append(pairs.count())
        return settled(pairs, texts, words)

    monkeypatch.setattr(shingles, "settled", counted)
    return counts


def kept(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], NAMES)
    return sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())


def copies(rng, n, edits, length=150):
    base = [f"w{k}" for k in range(length)]
    return [" ".join(edited(base, rng, rng.randrange(*edits))) for _ in range(n)]


def test_near_copies_are_not_settled_pair_by_pair(spark, asked):
    texts = copies(random.Random(5), 500, (1, 7))
    want, links = plain_kept(list(enumerate(texts)))
    assert 1 < len(want) < len(texts) and links > len(texts)
    assert kept(spark, texts) == want
    assert sum(asked) <= 20 * len(texts)


@pytest.mark.parametrize("few", [1, 4])
def test_crowded_groups_are_exact(spark, monkeypatch, few):
    """Chains, shared edits, texts around one passage, other lengths and wordless texts, all by their differences."""
    monkeypatch.setattr(shingles, "FEW", few)
    rng = random.Random(7)
    texts = copies(rng, 120, (1, 12), 120)
    for t in rng.sample(texts, 40):  # chains that share the edits of their text
        for _ in range(3):
            t = " ".join(edited(t.split(), rng, 2))
            texts.append(t)
    passage = [f"p{k}" for k in range(60)]
    for k in range(150):
        own = [f"o{k // 2}x{j}" for j in range(rng.randrange(1, 60))]
        texts.append(" ".join(own + passage if k % 3 else passage + own))
    texts += [t.rsplit(" ", rng.randrange(1, 30))[0] for t in texts[:60]] + ["", " ", None, "a b", "A  b"]
    rng.shuffle(texts)
    want, links = plain_kept(list(enumerate(texts)))
    assert links > 300 and 100 < len(want) < len(texts)
    assert kept(spark, texts) == want
