"""Tokens, Arrow files, packing, mixing, search, sound and quality against plain versions."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from zlib import crc32

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sightline.llm import arrow_stream, audio, block_max, mixing, packing, site_quality
from sightline.llm.queries import BM25_SQL, MIX_SQL, QUERIES, read
from sightline.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
ENCODER = Encoder(PATH, memo_words=50)
ODD = [None, "", " ", "\n", "  a  b", "a \n b", "x\n\ny z", " lead", "trail ", "tab\t x", "it's  I'll don't", "漢字 テスト 🙂 🙂", "é è\nà ß", "q\r\n w", "x <|endoftext|> y", "\x1c a \x1f b", "1 234 5,6", "a" * 30_000, "long words " * 5_000]


def table(spark, rows):
    names = "doc_id long, text string, lang string, source string, n_chars long, size string, length int, copies int, weight int, row int, evidence int, host int"
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", 1, 2, 3, 4, 5, 6) for i, t, s in rows], names)


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


# --- tokens

@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab's 1.,\n\t  é漢🙂<|endoftext|>"), max_size=60), max_size=4))
def test_memo_gives_the_library_ids(texts):
    assert [np.frombuffer(x, ENCODER.dtype).tolist() for x in ENCODER.encode(texts)] == [ids_of(t) for t in texts]


def test_line_feeds_are_cut_only_where_they_stand_alone():
    texts = ["a\nb", "\na b\n", "a\n\nb c", "x y\n\n\nz", "a\n", "\n", "\n\n", "a b\n's it", "a \n  b", "q a\n.\nb, c.\nD", "\n  ab c", "a\x1c\nb", "k\u3000\nl", "w \n\tv"]
    for some in (texts, texts[::-1], texts):
        assert [np.frombuffer(x, ENCODER.dtype).tolist() for x in ENCODER.encode(some)] == [ids_of(t) for t in some]


def test_other_tokenizers_encode_whole_texts():
    other = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert not other.by_word
    assert np.frombuffer(other.encode(["Some words here"])[0], other.dtype).tolist() == other.whole.encode("Some words here", add_special_tokens=False).ids


def crc_of(ids):
    return crc32(np.array(ids, "<u4").tobytes())


def test_arrow_files(spark):
    rows = [(i * 7 % 19, t, "s") for i, t in enumerate(ODD)] + [(3, "twice", "s"), (3, "twice", "s"), (None, "no id", "s")]
    got = arrow_stream.round_trip(table(spark, rows), PATH, length=16, file_tokens=300).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, at = [], 0
    for doc_id, text, _ in ordered:
        ids = [*ids_of(text), 2]
        want.append((doc_id, at, len(ids), crc_of(ids)))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert arrow_stream.round_trip(table(spark, []).limit(0), PATH).count() == 0


def test_arrow_file_layout(spark, tmp_path):
    docs = table(spark, [(i, "word " * (i * 40), "s") for i in range(12)])
    files = arrow_stream.write(docs, PATH, f"file://{tmp_path}/t", length=32, file_tokens=10_000).collect()
    paths = sorted((tmp_path / "t").glob("part-*.arrow"))
    assert len(files) == len(paths)
    total = 0
    for p in paths:
        reader = arrow_stream.sequences(p.read_bytes())
        assert reader.schema.field("ids").type == pa.list_(pa.uint16(), 32)
        b = reader.get_batch(0)
        assert b.column(0).values.to_numpy(zero_copy_only=True).shape == (b.num_rows * 32,)
        total += sum(reader.get_batch(k).column(1).values.to_numpy(zero_copy_only=False).sum() for k in range(reader.num_record_batches))
    assert total == sum(f.tokens for f in files)


# --- packing

def test_pieces(spark):
    rows = [(i, t, "s") for i, t in enumerate(ODD)]
    got = sorted(map(tuple, packing.pieces(table(spark, rows), PATH, 64).collect()))
    want = []
    for doc_id, text, _ in rows:
        ids = [*ids_of(text), 0]
        first = len(ids) % 64 or min(len(ids), 64)
        cuts = [0, *range(first, len(ids), 64), len(ids)]
        want += [(doc_id, k, a, b - a, crc_of(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert got == sorted(want)


def assert_packed(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity
    return len(by)


def test_packing(spark):
    rng = random.Random(1)
    lengths = [rng.choice([1, 2, 700, 701, 1023, 1024, 1025, 2047, 2048, rng.randrange(1, 2049)]) for _ in range(3_000)]
    items = spark.createDataFrame([(i % 50, n, "x") for i, n in enumerate(lengths)], "doc_id long, length long, _part string")
    packed = packing.pack(items.select("doc_id", "length"), per_part=400).collect()
    assert Counter((r.doc_id, r.length) for r in packed) == Counter((i % 50, n) for i, n in enumerate(lengths))
    bins = assert_packed(packed, 2048)
    least = packing.least_bins(np.array(lengths), 2048)
    assert least <= bins <= 1.01 * least + 2
    assert packing.pack(items.select("doc_id", "length").limit(0)).count() == 0


def optimum(lengths, capacity):
    best = len(lengths)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= lengths[i]:
                place(i + 1, [*rooms[:j], rooms[j] - lengths[i], *rooms[j + 1 :]])
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=7))
def test_bounds_never_exceed_the_optimum(lengths):
    lengths = sorted(lengths, reverse=True)
    bins, offsets, held = packing.best_fit(np.array(lengths), 20)
    assert packing.least_bins(np.array(lengths), 20) <= optimum(lengths, 20) <= len(held)
    assert all(held[b] == sum(n for n, c in zip(lengths, bins) if c == b) for b in range(len(held)))


# --- mixing

MIXED = [(i, "w " * (i % 13 * 5), f"s{i % 5}" if i % 5 else None) for i in range(400)] + [(900, "tiny text", "t1"), (901, None, "t2"), (902, "", "t1"), (903, "w\x0bw w x" * 900, "Z"), (903, "w\x0bw w x" * 900, "Z")]


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: 1.0 + i % 3 for i, s in enumerate(order)}
    target, free, total = {}, set(order), sum(sizes.values())
    while True:
        level = (total - sum(target.values())) / sum(weights[s] for s in free)
        over = {s for s in free if level * weights[s] > 3 * sizes[s]}
        if not over:
            return target | {s: level * weights[s] for s in free}
        target |= {s: 3 * sizes[s] for s in over}
        free -= over


def test_mixing(spark):
    got = mixing.mix(table(spark, MIXED)).collect()
    assert len(got) == len(MIXED)
    sizes = Counter()
    for _, t, s in MIXED:
        sizes[s] += len((t or "").replace(" ", "_").split())
    target = plain_targets(sizes)
    taken, longest = Counter(), Counter()
    for r in got:
        s = r.source_key[1:] if r.source_key[0] == "0" else None
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s]) and 0 <= r.copies <= 3
        taken[s] += r.size * r.copies
        longest[s] = max(longest[s], r.size)
    assert all(abs(taken[s] - target[s]) <= longest[s] / 2 + 1e-6 for s in sizes)
    again = mixing.mix(table(spark, MIXED).repartition(7))
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, got))
    assert mixing.mix(table(spark, []).limit(0)).count() == 0


def test_mixing_agrees_with_its_sql(spark):
    mixed = mixing.mix(table(spark, MIXED))
    got = Counter((r.doc_id, r.size, r.source_size, round(r.target, 4), r.size * r.copies) for r in mixed.collect())
    documents = pa.table({"doc_id": [r[0] for r in MIXED], "text": [r[1] for r in MIXED], "source": [r[2] for r in MIXED]})  # noqa: F841
    assert Counter(duckdb.connect().execute(MIX_SQL).fetchall()) == got


def test_given_weights(spark):
    weights = spark.createDataFrame([("s1", 2.0), ("s2", 1.0)], "source string, weight double")
    taken = Counter()
    for r in mixing.mix(table(spark, MIXED), weights=weights).collect():
        taken[r.source_key] += r.size * r.copies
    assert set(+taken) == {"0s1", "0s2"}


# --- search

def plain_search(rows, k):
    docs = [(d, block_max.terms(t)) for d, t in rows]
    mean, df = sum(len(t) for _, t in docs) / len(docs), Counter(w for _, t in docs for w in set(t))
    counts = [(d, Counter(t), len(t)) for d, t in docs]
    out = []
    for q, words in docs:
        if q is None or q % 5:
            continue
        found = []
        for d, c, n in counts:
            s = round(sum(m * math.log1p((len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * n / mean)) for w, m in Counter(words).items() if w in c), 6)
            if s > 0 and d is not None:
                found.append((-s, d))
        out += [(q, i + 1, d, -s) for i, (s, d) in enumerate(sorted(found)[:k])]
    return sorted(out)


def test_search(spark, monkeypatch):
    monkeypatch.setattr(block_max, "SEGMENT_TOKENS", 400)
    rng = random.Random(6)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(200)], k=rng.randrange(1, 60)))) for i in range(200)]
    rows += [(200, None), (205, ""), (210, rows[10][1].upper()), (215, rows[10][1]), (220, "no-match-zzz, ß"), (225, "w1 " * 5_000)]
    docs = table(spark, [(i, t, "s") for i, t in rows])
    got = block_max.search(docs, docs.where("doc_id % 5 = 0").select(F.col("doc_id").alias("query_id"), "text"), 7)
    got = sorted(map(tuple, got.collect()))
    want = plain_search(rows, 7)
    assert [g[:3] for g in got] == [w[:3] for w in want] and all(g[3] == pytest.approx(w[3], abs=2e-6) for g, w in zip(got, want))
    none = table(spark, []).limit(0)
    assert block_max.search(none, none.select(F.col("doc_id").alias("query_id"), "text")).count() == 0


def test_blocks_are_skipped():
    rng = np.random.default_rng(1)
    n, vocabulary = 4_000, np.arange(1, 3_001)
    docs = [np.sort(rng.choice(3_000, 20, replace=False)) for _ in range(n)]
    term, doc = np.concatenate(docs), np.repeat(np.arange(n), 20)
    by = np.lexsort((doc, term))
    segment = {"vocabulary": vocabulary, "frequency": np.bincount(term, minlength=3_000), "doc_ids": list(range(n)), "lengths": [20] * n, "docs": doc[by].astype("<u4").tobytes(), "counts": np.ones(n * 20, "<u4").tobytes()}
    shard = block_max.Shard([segment], 20.0)
    query = [(q, docs[q] + 1, np.ones(20)) for q in range(40)]
    found = shard.search(query, 1)
    assert [(q, d) for q, d, _ in found] == [(q, q) for q in range(40)]
    assert shard.skipped > 4 * shard.scored


# --- sound

def test_wav_and_payload():
    for text, size in ((None, 192), ("", 192), ("x" * 192, 192), ("é" * 97, 384)):
        p, n = audio.payload(text)
        assert len(p) == size and n == len((text or "").encode()) and audio.from_wav(audio.to_wav(p)) == (p, audio.RATE)


@pytest.mark.parametrize(("up", "down"), [(1, 2), (3, 4), (2, 1), (3, 2)])
def test_polyphase_is_upsample_filter_downsample(up, down):
    x = np.random.default_rng(0).normal(size=777).astype(np.float32)
    y, h = audio.resample(x, up, down), audio.low_pass(up, down)
    wide = np.zeros(len(x) * up)
    wide[::up] = x
    assert np.allclose(y, np.convolve(wide, h)[len(h) // 2 :: down][: len(y)], atol=1e-5)


def test_mel_and_segments():
    x = np.random.default_rng(0).normal(size=1_000).astype(np.float32)
    mel, _ = audio.log_mel(x, 8_000)
    frame = x[80:280] * np.hanning(200)
    power = np.abs(np.array([sum(frame[t] * np.exp(-2j * np.pi * k * t / 256) for t in range(200)) for k in range(129)])) ** 2
    assert np.allclose(mel[1], np.log(power @ audio.mel_bank(8_000)), atol=1e-3)
    energy = np.array([0, 0, 2, 0, 0.5, -2, 0, 0, 3, 3, -2, -2, 0], float)
    on, out, state = [], [], False
    for i, e in enumerate(energy):
        state = e >= 1 or state and e >= -1
        on.append(state)
    for i, s in enumerate(on):
        if s and (i == 0 or not on[i - 1]):
            out.append([i, i])
        if s:
            out[-1][1] = i + 1
    assert audio.segments(energy) == [tuple(x) for x in out]


def test_sound_columns(spark, sf_dir):
    rows = [(i, t, "s") for i, t in enumerate([*ODD, "same", "same"])]
    found = audio.features(audio.store(table(spark, rows), "doc_id", "length")).collect()
    assert len(found) == len(rows)
    for r in found:
        p, n = audio.payload(rows[r.doc_id][1])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(p), hashlib.sha256(p).hexdigest(), crc32(p[-16:]))
        stored = pa.ipc.open_stream(r.tensors).read_all()
        assert isinstance(stored.schema.field("log_mel").type, pa.FixedShapeTensorType) and stored.schema.field("log_mel").type.shape == [64, 40]
        assert stored["end_s"][-1].as_py() == pytest.approx(r.frames * audio.HOP / 8_000)
    same = [r for r in found if rows[r.doc_id][1] == "same"]
    assert same[0].tensors == same[1].tensors and same[0].media == same[1].media
    assert QUERIES["op3_audio_features"](spark, sf_dir).count() == read(spark, sf_dir, "documents").count()


# --- quality

def test_posteriors(spark):
    rng = random.Random(2)
    rows = [(i, f"h{min(i % 9, 3)}" if i % 11 else None, f"p{i % 4}", round(rng.random(), 3)) for i in range(300)]
    got = {r.doc_id: r for r in site_quality.posteriors(spark.createDataFrame(rows, "doc_id long, host string, path string, evidence double")).collect()}
    hosts, paths = defaultdict(list), defaultdict(list)
    for _, h, p, e in rows:
        hosts[h].append(e)
        paths[h, p].append(e)
    mean = sum(e for *_, e in rows) / len(rows)

    def strength(groups):
        n, h = sum(len(x) for x, _ in groups), len(groups)
        within = sum(sum(v * v for v in x) - sum(x) ** 2 / len(x) for x, _ in groups) / (n - h)
        between = sum(len(x) * (sum(x) / len(x) - prior) ** 2 for x, prior in groups) / (h - 1)
        tau = (between - within) / ((n - sum(len(x) ** 2 for x, _ in groups) / n) / (h - 1))
        return min(within / tau, 1e6) if tau > 0 else 1e6

    k1 = strength([(x, mean) for x in hosts.values()])
    k2 = strength([(x, (k1 * mean + sum(hosts[h])) / (k1 + len(hosts[h]))) for (h, _), x in paths.items()])
    logit = lambda p: math.log(p / (1 - p))
    for i, h, p, e in rows:
        host = (k1 * mean + sum(hosts[h]) - e) / (k1 + len(hosts[h]) - 1)
        path = (k2 * host + sum(paths[h, p]) - e) / (k2 + len(paths[h, p]) - 1)
        assert got[i].host_posterior == pytest.approx(host) and got[i].path_posterior == pytest.approx(path)
        if 0 < e < 1:
            assert got[i].posterior == pytest.approx(1 / (1 + math.exp(-(logit(e) + logit(path) - logit(mean)))))


def test_sparse_groups_stay_near_their_prior(spark):
    rows = [(i, f"h{i % 10}", "p", 0.9 if i % 10 < 5 else 0.3) for i in range(2_000)] + [(9_999, "new", "p", 0.01)]
    got = {r.doc_id: r for r in site_quality.posteriors(spark.createDataFrame(rows, "doc_id long, host string, path string, evidence double")).collect()}
    assert abs(got[9_999].host_posterior - 0.6) < 0.01 and got[0].host_posterior > 0.85 and got[5].host_posterior < 0.35


def test_quality_edges(spark):
    docs = table(spark, [(1, None, None), (2, "", "a"), (2, "", "a"), (None, "x", "a"), (4, "word " * 20_000, "b")])
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    got = site_quality.score(docs, labels, "source", "lang").collect()
    assert len(got) == 5 and all(r.keep and r.evidence == 0.5 for r in got)
    both = spark.createDataFrame([(1, 0, 0), (2, 1, None), (4, 1, 0)], "doc_id long, quality int, toxic int")
    assert site_quality.score(docs, both, "source", "lang").count() == 5
    assert site_quality.score(docs.limit(0), both, "source", "lang").count() == 0


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    known = labels.withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0)
    copies = docs.join(known.where("held"), "doc_id").select("text").distinct()
    train = known.where("NOT held").join(docs.join(copies, "text", "left_semi").select("doc_id"), "doc_id", "left_anti").drop("held")
    scored = site_quality.score(docs, train, "source", "lang").join(known.where("held"), "doc_id")
    n = {(r.good, r.keep): r["count"] for r in scored.groupBy(((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"), "keep").count().collect()}
    kept = n[True, True] / (n[True, True] + n.get((True, False), 0))
    caught = n[False, False] / (n[False, False] + n.get((False, True), 0))
    assert kept >= 0.98 and caught >= 0.7, (kept, caught)
