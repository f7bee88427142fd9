"""Contained texts against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.operators import containment, knowledge
from sightline.session import cut


@pytest.mark.parametrize(("least", "size"), containment.CLASSES)
def test_stretches_share_their_pieces(least, size, monkeypatch):
    monkeypatch.setattr(containment, "_BLOCK", 700)
    rng = random.Random(least)
    for _ in range(20):
        text = "".join(rng.choice("abcdé \U0001f600") for _ in range(least + rng.randrange(3000)))
        all_pieces = set(containment.pieces(text, least, size).tolist())
        a = rng.randrange(len(text) - least + 1)
        inner = text[a : a + least + rng.randrange(len(text) - least - a + 1)]
        own = containment.pieces(inner, least, size)
        assert len(own) and set(own.tolist()) <= all_pieces
    assert len(containment.pieces("x" * (least - 1), least, size)) == 0
    assert containment.pieces("y" * least, least, size).dtype == np.int64


def plain(rows):
    return sorted(i for i, g, part, page in rows if any(h == g and (q, other) < (page, part) and part in other for j, h, other, q in rows if j != i))


@pytest.mark.parametrize("seed", range(3))
def test_contained(spark, seed):
    rng = random.Random(seed)
    words = [rng.choice("abcdefgh") * rng.randrange(1, 5) for _ in range(30)]
    rows, seen = [], set()
    for _ in range(260):
        group = rng.choice(["hot", "hot", "hot", "b", None])
        text = " ".join(rng.choice(words) for _ in range(int(rng.paretovariate(0.6)) % 600 + 1))
        for part in (text, text[rng.randrange(len(text)) :], text[: rng.randrange(len(text)) + 1], "boilerplate start of every text " + text):
            if (group, part) not in seen and rng.random() < 0.6:
                seen.add((group, part))
                rows.append((len(rows), group, part, rng.randrange(50)))
    table = cut(spark.createDataFrame(rows, "id long, g string, part string, page int"))
    got = [r.id for r in containment.contained(table, ["g"], F.struct("page", "part")).collect()]
    assert sorted(got) == plain(rows) and len(got) > 20


def test_one_species_with_many_pages(spark):
    """A third of all pages are one species; its record is the fold of its pages, and no piece pairs all of them."""
    rng = random.Random(4)
    texts = ["Control this plant by " + " ".join(rng.choice(["root", "leaf", "stem", "sap"]) + str(rng.randrange(900)) for _ in range(40)) for _ in range(150)]
    texts += [t[10:90] for t in texts[::3]] + texts[::5] + ["", None]
    rows = [("Acacia hot", ["Wattle"], None, None, "near rivers", None, t, None, i) for i, t in enumerate(texts)]
    rows += [(f"Acacia s{i}", [], "F", "o", None, None, t, None, 1000 + i) for i, t in enumerate(texts[:100])]
    names = "scientific_name string, common_names array<string>, family string, origin string, where_found string, identification string, treatment string, poisonous string, page_hint int"
    merged = {r.scientific_name: r for r in knowledge.merge_species(spark.createDataFrame(rows, names)).collect()}
    want = ""
    for t in texts:
        if t and t not in want:
            want = f"{want}\n\n{t}" if want else t
    assert merged["Acacia hot"].treatment == want and merged["Acacia hot"].where_found == "near rivers" and len(merged) == 101
    assert merged["Acacia s3"].treatment == texts[3] and merged["Acacia hot"].identification is None
