"""Groups of few texts are compared as they are; larger ones and long ones are cut into pieces, and all give the same."""

import random

import pytest
from pyspark.sql import functions as F

from sightline.operators import containment
from sightline.session import cut
from test_containment import plain


def parts(rng, groups, most):
    rows = []
    for g in groups:
        base = " ".join(rng.choice(["root", "leaf", "ä", "sap"]) + str(rng.randrange(30)) for _ in range(60))
        texts = {base[(a := rng.randrange(len(base))) : rng.randrange(a + 1, len(base) + 1)] for _ in range(rng.randrange(1, most))}
        rows += [(len(rows) + i, g, t, rng.randrange(4)) for i, t in enumerate(sorted(texts))]
    return rows


def refuse(batches):
    for batch in batches:
        if batch.num_rows:
            raise AssertionError("cut into pieces")
        yield batch


def test_few_texts_are_not_cut(spark, monkeypatch):
    rows = parts(random.Random(5), [None, *"abcdefgh"], 16)
    table = cut(spark.createDataFrame(rows, "id long, g string, part string, page int"))
    monkeypatch.setattr(containment, "_cut_up", lambda batches: refuse(batches))
    got = [r.id for r in containment.contained(table, ["g"], F.struct("page", "part")).collect()]
    assert sorted(got) == plain(rows) and len(got) > 10


@pytest.mark.parametrize(("few", "letters"), [(16, 1 << 20), (8, 1 << 20), (40, 900), (0, 0)])
def test_both_ways_agree(spark, monkeypatch, few, letters):
    monkeypatch.setattr(containment, "FEW", few)
    monkeypatch.setattr(containment, "FEW_LETTERS", letters)
    rows = parts(random.Random(6), [None, *"abcdefgh"], 30)
    table = cut(spark.createDataFrame(rows, "id long, g string, part string, page int"))
    got = [r.id for r in containment.contained(table, ["g"], F.struct("page", "part")).collect()]
    assert sorted(got) == plain(rows) and len(got) == len(set(got))
