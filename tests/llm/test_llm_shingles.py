"""The pipeline's near-duplicates against all pairs of texts."""

import itertools
import random

import corpus_pipeline
from sightline.llm.queries import read

NAMES = "doc_id long, text string, lang string, source string, n_chars long"


def plain_shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_kept(rows):
    """Smallest id of each group of texts that are linked at 0.8 or more."""
    root, sets = list(range(len(rows))), [plain_shingles(t) for _, t in rows]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = 0
    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if 5 * both >= 4 * len(sets[i] | sets[j]):
            links += rows[i][1] != rows[j][1]
            root[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted(least.values()), links


def edited(words, rng, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.randrange(10**6)}"
    return words


def test_texts_at_four_fifths_are_one(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(40):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(20, 300))]
        chain = base
        for _ in range(3):  # a chain of texts whose ends are far apart
            texts.append(" ".join(chain))
            chain = edited(chain, rng, max(1, len(base) // 50))
        texts.append(" ".join(edited(base, rng, max(1, len(base) // 20))))
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, " "), (902, texts[0].upper()), (903, texts[0])]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], NAMES)
    want, links = plain_kept(rows)
    assert links > 50
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == want


def test_given_documents_at_four_fifths(spark, sf_dir):
    docs = read(spark, sf_dir.replace("sf0.001", "sf0.01"), "documents")
    want, links = plain_kept([(r.doc_id, r.text) for r in docs.collect()])
    assert links > 0
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == want
