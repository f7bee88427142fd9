"""Merkle logs, coordinate-pruned negatives and hashed lines against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.llm import coordinate_lists, line_hash, merkle
from sightline.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree int, at int, shard int, carry string, path string"


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


# --- Merkle log

def plain_leaf(r, text):
    values = [None if v is None else str(v) for v in (r[0], r[3], r[2], r[4])] + [text]
    return digest("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain_proof(levels, at):
    out = []
    for nodes in levels[:-1]:
        first = at // 3 * 3
        out.append((nodes[first:at], nodes[at + 1 : first + 3]))
        at //= 3
    return out


def plain_manifest(rows):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups = []
    for s in sources:
        own = sorted(((r[0] is not None, r[0] or 0), plain_leaf(r, r[1]), r[0], plain_leaf(r, r[1] and r[1].replace("\n", ""))) for r in rows if r[3] == s)
        groups.append((own, plain_levels([x[1] for x in own])))
    top = plain_levels([levels[-1][0] for _, levels in groups])
    out = []
    for g, (own, levels) in enumerate(groups):
        for at, (_, leaf, doc_id, tampered) in enumerate(own):
            proof = plain_proof(levels, at) + plain_proof(top, g)
            node = tampered if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 else leaf
            for before, after in proof:
                node = digest("".join(before) + node + "".join(after))
            siblings = digest("".join(x for p in proof for side in p for x in side))
            out.append((doc_id, leaf, levels[-1][0], top[-1][0], siblings, node, node == top[-1][0]))
    return sorted(out, key=str)


def merkle_rows(n, seed):
    rng = random.Random(seed)
    rows = [(None, "lost", "en", "s1", 4), (None, "lost", "en", "s1", 4), (7, None, None, None, None), (8, "", "", "", 0), (9, "-", "-", "-", 1), (10, "one\ntwo", "de", "aé", 7), (11, "long " * 40_000, "en", "\U0001f600", 9), (12, "x", "y", "￿", 1)]
    for i in range(n):
        rows.append((rng.randrange(10**9), f"text\n{i}" * rng.randrange(4), "en", rng.choice(["big", "big", "s1", "s2"]), i))
    return [(*r, 1, 2, 3, "c", "p") for r in rows]


@pytest.mark.parametrize(("n", "height"), [(0, 1), (40, 1), (200, 2), (500, 6)])
def test_merkle(spark, tmp_path, n, height, monkeypatch):
    rows = merkle_rows(n, n)
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    build = merkle.build
    monkeypatch.setattr(merkle, "build", lambda *a: build(*a, height=height))
    got = QUERIES["op11_merkle_log"](spark, str(tmp_path)).collect()
    assert sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in got), key=str) == plain_manifest(rows)


def test_merkle_of_nothing_and_of_one(spark, tmp_path):
    empty = spark.createDataFrame([], DOCS)
    empty.write.parquet(f"{tmp_path}/a/documents.parquet")
    assert QUERIES["op11_merkle_log"](spark, f"{tmp_path}/a").count() == 0
    spark.createDataFrame([(1, "a\nb", "en", "s", 3, 1, 2, 3, "c", "p")], DOCS).write.parquet(f"{tmp_path}/b/documents.parquet")
    (r,) = QUERIES["op11_merkle_log"](spark, f"{tmp_path}/b").collect()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == digest("")


def test_positions_are_the_order_of_completion():
    for n in [*range(1, 60), 81, 82, 243, 300]:
        height = merkle._levels(n)
        leaves = [str(i) for i in range(n)]
        log = merkle.append_log(leaves, height)
        levels = plain_levels(leaves)
        places = {merkle.position(k, i, n): x for k, nodes in enumerate(levels) for i, x in enumerate(nodes)}
        assert log == [places[i] for i in range(len(places))]


@pytest.mark.parametrize("height", [1, 2, 6])
def test_log_equals_that_of_one_builder(spark, height):
    rows = spark.range(0, 130).select(F.col("id"), F.when(F.col("id") < 100, "a").otherwise("b").alias("s"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    made = merkle.build(rows, F.col("leaf"), ["s"], ["id"], [F.col("id")], height)
    got = {}
    for r in made.log().orderBy("tree", "position").collect():
        got.setdefault(r.tree, []).append((r.position, r.node))
    for tree, ids in ((0, range(100)), (100, range(100, 130))):
        want = merkle.append_log([digest(str(i)) for i in ids], merkle._levels(len(ids)))
        assert got[tree] == list(enumerate(want))


# --- hard negatives

def plain_negatives(rows, positives=5, negatives=5):
    kept = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [int(np.floor(256 * float(x))) for x in v]) for i, v, lab in rows
            if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, lab, v in kept:
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other == lab) for j, other, w in kept if j != i)
        for s, j, same in [x for x in scored if x[2]][:positives]:
            found = [(t, k) for t, k, same2 in scored if not same2 and -80 * s <= -100 * t <= -100 * s][:negatives]
            out += [(i, j, r, k, -s, -t) for r, (t, k) in enumerate(found, 1)]
    return sorted(out)


def vectors(n, seed, scale=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(10, 8))
    rows = []
    for i in range(n):
        lab = int(rng.integers(10))
        rows.append((i, [float(np.float32(x)) for x in scale * (centres[lab] + rng.normal(size=8)) * rng.uniform(0.2, 2)], lab))
    return rows


ODD = [(1001, None, 1), (1002, [1.0] * 8, None), (1003, [None] + [1.0] * 7, 2), (1004, [float("nan")] + [1.0] * 7, 2), (1005, [float("inf")] + [1.0] * 7, 2),
       (None, [1.0] * 8, 3), (1100, [0.0] * 8, 4), (1101, [], 4), (1102, [1.0], 4), (1200, [0.5] * 12, 4)]
KINDS = "vec_id long, embedding array<float>, label int, bucket int, slab int, windows string"


def mined(spark, rows, **more):
    table = spark.createDataFrame([(*r, 1, 2, "w") for r in rows], KINDS)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return coordinate_lists.hard_negatives(table.withColumn("label", label), F.col("vec_id") % 100 == 0, **more)


@pytest.mark.parametrize(("n", "bucket", "slab"), [(0, 8, 8), (60, 8, 2), (700, 64, 3), (700, 8192, 4096)])
def test_negatives(spark, n, bucket, slab):
    rows = vectors(n, n) + (ODD if n else [])
    got = mined(spark, rows, bucket=bucket, slab=slab).collect()
    assert sorted(map(tuple, got)) == plain_negatives(rows)


def test_negatives_with_copies_and_large_values(spark):
    rows = vectors(300, 5, 1e5)
    rows += [(1000 + i, rows[100][1], i % 2) for i in range(150)]  # copies of an anchor, half of them of another label
    assert sorted(map(tuple, mined(spark, rows, bucket=50, slab=2).collect())) == plain_negatives(rows)


def test_coordinate_lists_rule_vectors_out(spark):
    numbers = coordinate_lists.whole_numbers(spark.createDataFrame(vectors(2000, 9), "vec_id long, embedding array<float>, label int"))
    buckets = [coordinate_lists.Bucket(r.asDict()) for r in coordinate_lists.index(numbers, 200).orderBy("bucket").collect()]
    assert len(buckets) == 10 and all(a.longest >= b.longest for a, b in zip(buckets, buckets[1:]))
    looked = 0
    for a in numbers.where("vec_id % 100 = 0").collect():
        q = np.array(a.v)
        low = sorted(buckets[0].scores(q, None)[buckets[0].labels == a.label])[-5:][0]
        for b in buckets[1:]:
            rows = b.candidates(q, low)
            assert set(np.flatnonzero(b.scores(q, None) >= low)) <= set(rows)
            looked += len(rows)
    assert looked <= 0.25 * 20 * 1800


# --- lines

def plain_lines(rows):
    def key(line):
        k = line.strip("\x20\x09\x0a\x0b\x0c\x0d")
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in k)

    last = 1 << 63
    first = {}
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                first[key(line)] = min(first.get(key(line), last), last if i is None else i)
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if first.get(key(x), last) >= (last if i is None else i)]
        out.append((i, len(lines), len(lines) - len(kept), digest("\n".join(kept))))
    return sorted(out, key=str)


def line_rows(n, seed):
    rng = random.Random(seed)
    pool = [f"{rng.choice(['Some', 'SOME', 'some', 'äöü'])} line {rng.randrange(60)}" for _ in range(200)] + ["short", "123456789", "1234567890", "ääääääääää", "ÄÄÄÄÄÄÄÄÄÄ", " nine nine"]
    rows = [(None, "a line in every document\nlost", "en", "s", 1), (None, "a line in every document\nlost", "en", "s", 1), (3, None, "en", None, None), (4, "", "en", "s", 0), (5, "\n\n", "en", "s", 2), (2, "twice here twice\nx\ntwice here twice", "en", "s", 1),
            (2, "twice here twice\nother", "en", "s", 1), (9, " TWICE here twice\t\r\ntwice here twicE\vy", "en", "s", 1), (11, "word " * 60_000 + "\n" + "line of many\n" * 5_000, "en", "s", 1), (12, "line of many\n" * 5_000, "en", "s", 1)]
    rows += [(20 + i, "\n".join(["a line in every document"] + [rng.choice([" ", "\t", "", "\r"]) + rng.choice(pool) + rng.choice(["", " ", "\x0b"]) for _ in range(rng.randrange(12))]), "en", "s", 1) for i in range(n)]
    return [(*r, 1, 2, 3, "c", "p") for r in rows]


@pytest.mark.parametrize(("n", "shard", "probe"), [(0, 10, 10), (150, 20, 5), (400, 100, 50), (400, line_hash.SHARD_LINES, line_hash.PROBE_LINES)])
def test_lines(spark, n, shard, probe):
    rows = line_rows(n, n)
    got = line_hash.drop_repeated_lines(spark.createDataFrame(rows, DOCS).repartition(5), shard_lines=shard, probe_lines=probe).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, digest(r.text)) for r in got), key=str) == plain_lines(rows)


def test_no_lines(spark):
    assert line_hash.drop_repeated_lines(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 1000, 50_000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    h1, h2 = rng.integers(0, 1 << 63, n, dtype=np.uint64), rng.integers(0, 1 << 63, n, dtype=np.uint64)
    h1[: n // 10] = 5  # keys that differ in their second half only
    hashed = line_hash.PerfectHash.over(h1, h2)
    assert sorted(hashed.numbers(h1, h2)) == list(range(n))
    assert hashed.numbers(h1[:0], h2[:0]).size == 0


def test_keys_that_no_level_parts(monkeypatch):
    monkeypatch.setattr(line_hash, "_LEVELS", 1)
    h = np.arange(1000, dtype=np.uint64)
    hashed = line_hash.PerfectHash.over(h, h * np.uint64(3))
    assert len(hashed.rest) and sorted(hashed.numbers(h, h * np.uint64(3))) == list(range(1000))


def test_unseen_lines_are_told_by_their_fingerprint(spark):
    known = spark.createDataFrame(line_rows(100, 1), DOCS)
    lines = line_hash.document_lines(known)
    (row,) = line_hash.index(lines, 1).collect()
    shard = line_hash.Shard(row.asDict())
    rng = np.random.default_rng(1)
    counts, _ = shard.look_up(rng.integers(0, 1 << 63, 10_000, dtype=np.uint64), rng.integers(0, 1 << 63, 10_000, dtype=np.uint64))
    assert not counts.any()
    assert row.n_keys == lines.select("h1", "h2").distinct().count() and row.n_lines == lines.count()
