"""Repeated byte strings, found by blockwise construction over a difference cover.

Sorting every suffix of a corpus needs more room than the corpus. Two things bound it here. A difference cover: of the
positions of a document only those whose remainder modulo 57 is in the cover are ranked; for any two positions some
shift below 57 brings both into the cover, so two equal strings of 100 bytes hold equal cover samples of 44 bytes at the
same shift. And blocks: suffixes are sorted one block of buckets at a time, and a block's tables are freed before the
next one.

1. Cover samples are ranked by their first 44 bytes, bucket by bucket. Samples of a rank that only one has are dropped;
   only suffixes with a repeated sample within reach can tie for 100 bytes.
2. Those suffixes are sorted to a depth of 100 bytes, block by block. Order only has to bring equal strings together, so
   keys are 96-bit fingerprints of the 100 bytes instead of their letters. Of each tie, the earliest suffix is the first
   occurrence.
3. Every other suffix of a tie covers 100 bytes that start earlier; the runs they cover are cut out.

Documents travel once, into tiles of a few MB in the order of their ids; later steps exchange only packed keys and one
bit per key. A tile sends each key once, so a string in every document costs one key per tile. Exact copies of whole
documents are found by their digest and take no part in the rest.

Defined results: NULL is the empty text; texts below the length lose nothing; rows that repeat are copies, the later in
order loses; NULL ids are earlier than all others; an empty table gives an empty result; further columns are not read. A
document is handled by one task, which needs a few times its size.
"""

from __future__ import annotations

import gc
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.session import cut, new_path

#: A perfect difference set: every shift modulo 57 is the difference of two members.
PERIOD, COVER = 57, (0, 1, 3, 13, 32, 36, 43, 52)
TILE_BYTES = 2 << 20
BUCKET_KEYS = 2_000_000  # keys of a bucket, about; a task sorts one bucket at a time
_SEGMENT = 1 << 19

_rng = np.random.default_rng(20_240_101)
_TABLES = _rng.integers(0, 1 << 63, (2, 256), np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = [int(x) * 2 + 1 for x in _rng.integers(1 << 40, 1 << 62, 2)]
_powers: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(which: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    if (which, width) not in _powers:
        n = _SEGMENT + width + 1

        def row(base: int) -> np.ndarray:
            x = np.full(n, base, np.uint64)
            x[0] = 1
            return np.multiply.accumulate(x)

        _powers[which, width] = row(_BASES[which]), row(pow(_BASES[which], -1, 1 << 64))
    return _powers[which, width]


def string_keys(data: np.ndarray, at: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """64-bit fingerprints of data[p : p + width] for the ascending positions ``at``.

    A polynomial over a random table of byte values, taken from running sums and then mixed.
    """
    up, down = _power_tables(which, width)
    out = np.empty(len(at), np.uint64)
    for c in range(0, len(data), _SEGMENT):
        a, b = np.searchsorted(at, [c, c + _SEGMENT])
        if a == b:
            continue
        part = data[c : c + _SEGMENT + width]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_TABLES[which][part] * up[: len(part)], out=sums[1:])
        p = at[a:b] - c
        h = (sums[p + width] - sums[p]) * down[p]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        out[a:b] = h ^ (h >> np.uint64(32))
    return out


def squeeze(keys: np.ndarray) -> bytes:
    """Ascending keys as the planes of their differences' bytes: high planes are zeros, which shuffles compress."""
    return np.diff(keys, prepend=np.uint64(0)).astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unsqueeze(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(packed, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(">u8").ravel().astype(np.uint64), dtype=np.uint64)


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)


class Tile:
    """Documents in the order of their ids; ``copies`` are digests of texts that an earlier tile has."""

    def __init__(self, row: dict, copies: list[bytes] | None):
        self.doc_ids, self.data = row["doc_ids"], np.frombuffer(row["data"], np.uint8)
        self.lengths = np.array(row["lengths"], np.int64)
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        self.digests = row["digests"]
        seen, self.copy = set(copies or ()), np.zeros(len(self.lengths), bool)
        for i, d in enumerate(self.digests):
            self.copy[i] = d in seen
            seen.add(d)

    def samples(self, width: int) -> np.ndarray:
        """Cover positions of all documents but copies that have ``width`` bytes after them."""
        inside = np.zeros(PERIOD, bool)
        inside[list(COVER)] = True
        grid = np.flatnonzero(inside[np.arange(int(self.lengths.max(initial=0))) % PERIOD])
        n = np.where(self.copy, 0, np.searchsorted(grid, self.lengths - width + 1))
        found = [s + grid[:k] for s, k in zip(self.starts.tolist(), n.tolist(), strict=True) if k]
        return np.concatenate(found) if found else np.empty(0, np.int64)

    def candidates(self, hits: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last position of the runs of suffixes that have one of the samples ``hits`` within reach."""
        doc = np.searchsorted(self.starts, hits, "right") - 1
        low, high = np.maximum(hits - PERIOD + 1, self.starts[doc]), np.minimum(hits, self.ends[doc] - width)
        low, high = low[high >= low], high[high >= low]
        if not len(low):
            return low, high
        begins = np.flatnonzero(np.concatenate([[True], low[1:] > np.maximum.accumulate(high)[:-1] + 1]))
        return low[begins], np.maximum.reduceat(high, begins)


def spread_runs(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    n = high - low + 1
    return np.arange(int(n.sum())) + np.repeat(low - (np.cumsum(n) - n), n) if len(n) else np.empty(0, np.int64)


class Ranked:
    """Keys of a tile in order, each once: ``keys``, their first place in ``at``, and which places are repeats."""

    def __init__(self, keys: np.ndarray, check: np.ndarray | None = None):
        order = np.argsort(keys)
        k = keys[order]
        new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
        if check is not None and (check[order][1:] != check[order][:-1])[~new[1:]].any():  # equal keys of unequal strings
            order = np.lexsort((check, keys))
            k, c = keys[order], check[order]
            new = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])
        begins = np.flatnonzero(new)
        self.keys = k[begins]
        self.first = np.minimum.reduceat(order, begins) if len(begins) else begins
        self.again = np.diff(np.append(begins, len(k))) > 1
        self.check = None if check is None else check[self.first]

    def spread(self, flags: np.ndarray, keys: np.ndarray, check: np.ndarray | None = None) -> np.ndarray:
        """For every place, the flag of its key."""
        if check is None or (self.keys[1:] != self.keys[:-1]).all():
            return flags[np.searchsorted(self.keys, keys)]
        pairs = {kc: f for kc, f in zip(zip(self.keys.tolist(), self.check.tolist(), strict=True), flags.tolist(), strict=True)}
        return np.array([pairs[kc] for kc in zip(keys.tolist(), check.tolist(), strict=True)], bool)


def _buckets(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of ascending keys, by their highest bits."""
    if not len(keys):
        return []
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    begins = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    return list(zip(bucket[begins].tolist(), begins.tolist(), [*begins[1:].tolist(), len(keys)], strict=True))


def _tiles(docs: DataFrame) -> DataFrame:
    """Documents in tiles, bucketed by tile so that later joins don't move them."""
    spark, tile_bytes = docs.sparkSession, TILE_BYTES

    def of(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0

        def made():
            row = {"tile": (part << 32) + k, "doc_ids": ids, "lengths": [len(t) for t in texts], "digests": [hashlib.sha256(t).digest() for t in texts], "data": b"".join(texts)}
            return pa.RecordBatch.from_pylist([row], schema)

        schema = pa.schema([("tile", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("digests", pa.list_(pa.binary())), ("data", pa.binary())])
        for b in stream:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = (text.as_py() or "").encode()
                if ids and size + len(t) > tile_bytes:
                    yield made()
                    k, ids, texts, size = k + 1, [], [], 0
                ids.append(doc_id)
                texts.append(t)
                size += len(t)
        if ids:
            yield made()

    ranged = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    tiles = ranged.mapInArrow(of, "tile long, doc_ids array<long>, lengths array<long>, digests array<binary>, data binary")
    name, parts = f"suffix_tiles_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    tiles.write.bucketBy(parts, "tile").option("path", new_path(spark, "tiles")).saveAsTable(name)
    return spark.table(name)


def _free(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps whose result is stored; it does so when the driver drops them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _per_tile(joined: DataFrame, step, schema: str) -> DataFrame:
    """Runs ``step(row)`` on every tile with what was joined to it; it gives lists of the columns of ``schema``."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    arrow = pa.schema([(n, kinds[c.split()[1]]) for n, c in zip(names, schema.split(", "), strict=True)])

    def of(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            for i in range(b.num_rows):
                rows = step({n: b.column(j)[i].as_py() for j, n in enumerate(b.schema.names)})
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return joined.mapInArrow(of, schema)


def _copies(tiles: DataFrame) -> DataFrame:
    """(tile, copies): the digests of a tile that an earlier tile has too."""
    held = tiles.select("tile", F.explode(F.array_distinct("digests")).alias("digest"))
    first = held.groupBy("digest").agg(F.min("tile").alias("first"), F.count("*").alias("n")).where("n > 1")
    return cut(held.join(first, "digest").where("tile > first").groupBy("tile").agg(F.collect_list("digest").alias("copies")))


def _answers(sent: DataFrame, settle) -> DataFrame:
    """(tile, answers): for the keys each tile sent to each bucket, one bit per key; ``settle`` has a whole bucket."""
    def of(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("tile")
        flags = settle(group)
        ends = np.cumsum(group["n"].to_numpy())
        bits = [_bits(flags[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        return pd.DataFrame({"tile": group["tile"], "bucket": group["bucket"], "n": group["n"], "bits": bits})

    found = sent.groupBy("bucket").applyInPandas(of, "tile long, bucket long, n long, bits binary")
    return cut(found.groupBy("tile").agg(F.collect_list(F.struct("bucket", "n", "bits")).alias("answers")))


def _answered(answers: list | None, n: int) -> np.ndarray:
    """The flags of a tile's keys, in order, from the answers of its buckets."""
    parts = [_flags(a["bits"], a["n"]) for a in sorted(answers or (), key=lambda a: a["bucket"])]
    flags = np.concatenate(parts) if parts else np.zeros(0, bool)
    if len(flags) != n:
        raise ValueError(f"{len(flags)} answers for {n} keys")
    return flags


def _repeated_samples(tiles: DataFrame, copies: DataFrame, width: int, bits: int) -> DataFrame:
    def send(row: dict) -> list:
        tile = Tile(row, row["copies"])
        ranks = Ranked(string_keys(tile.data, tile.samples(width), width) >> np.uint64(8))
        return [(b, row["tile"], j - i, squeeze(ranks.keys[i:j]), _bits(ranks.again[i:j])) for b, i, j in _buckets(ranks.keys << np.uint64(8), bits)]

    def settle(group: pd.DataFrame) -> np.ndarray:
        keys = np.concatenate([unsqueeze(k) for k in group["keys"]])
        again = np.concatenate([_flags(a, n) for a, n in zip(group["again"], group["n"], strict=True)])
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        return again

    sent = _per_tile(tiles.join(copies, "tile", "left"), send, "bucket long, tile long, n long, keys binary, again binary")
    return _answers(sent, settle)


def _candidates(tiles: DataFrame, copies: DataFrame, repeated: DataFrame, length: int, width: int) -> DataFrame:
    """(tile, low, high): the runs of suffixes that may tie."""
    def find(row: dict) -> list:
        tile = Tile(row, row["copies"])
        at = tile.samples(width)
        keys = string_keys(tile.data, at, width) >> np.uint64(8)
        ranks = Ranked(keys)
        hits = at[ranks.spread(_answered(row["answers"], len(ranks.keys)), keys)]
        low, high = tile.candidates(hits, length)
        return [(row["tile"], low.astype("<i8").tobytes(), high.astype("<i8").tobytes())]

    return cut(_per_tile(tiles.join(copies, "tile", "left").join(repeated, "tile", "left"), find, "tile long, low binary, high binary"))


class Block:
    """The suffixes of a tile that belong to one block of buckets, ranked."""

    def __init__(self, data: np.ndarray, low: bytes, high: bytes, length: int, block: int, blocks_log: int):
        at = spread_runs(np.frombuffer(low, "<i8"), np.frombuffer(high, "<i8"))
        keys = string_keys(data, at, length)
        mine = keys >> np.uint64(64 - blocks_log) == block if blocks_log else np.ones(len(keys), bool)
        self.at, self.keys = at[mine], keys[mine]
        self.check = (string_keys(data, self.at, length, 1) >> np.uint64(32)).astype("<u4")
        self.ranks = Ranked(self.keys, self.check)

    def repeats(self, earlier: np.ndarray) -> np.ndarray:
        """Positions whose string starts earlier too, in this tile or one before it."""
        first = np.zeros(len(self.at), bool)
        first[self.ranks.first[~earlier]] = True
        return self.at[~first]


def _later_suffixes(tiles: DataFrame, runs: DataFrame, length: int, bits: int, block: int, blocks_log: int) -> DataFrame:
    def send(row: dict) -> list:
        r = Block(np.frombuffer(row["data"], np.uint8), row["low"], row["high"], length, block, blocks_log).ranks
        return [(b, row["tile"], j - i, squeeze(r.keys[i:j]), r.check[i:j].tobytes()) for b, i, j in _buckets(r.keys, bits)]

    def settle(group: pd.DataFrame) -> np.ndarray:
        keys, check = np.concatenate([unsqueeze(k) for k in group["keys"]]), np.concatenate([np.frombuffer(c, "<u4") for c in group["check"]])
        order = np.lexsort((check, keys))  # stable: of a tie, the earliest tile comes first
        k, c = keys[order], check[order]
        later = np.zeros(len(keys), bool)
        later[order[1:][(k[1:] == k[:-1]) & (c[1:] == c[:-1])]] = True
        return later

    sent = _per_tile(tiles.select("tile", "data").join(runs, "tile"), send, "bucket long, tile long, n long, keys binary, check binary")
    return _answers(sent, settle).withColumn("block", F.lit(block))


def _cut_out(tile: Tile, doc: int, spans: list[tuple[int, int]]) -> tuple:
    a, b = int(tile.starts[doc]), int(tile.ends[doc])
    kept, at = hashlib.sha256(), a
    view = memoryview(tile.data)
    for low, high in spans:
        kept.update(view[at:low])
        at = high
    kept.update(view[at:b])
    return tile.doc_ids[doc], b - a, sum(high - low for low, high in spans), len(spans), kept.hexdigest(), ",".join(f"{low - a}:{high - a}" for low, high in spans)


def remove_repeats(docs: DataFrame, length: int = 100, blocks_log: int = 1) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every row of ``docs`` (doc_id, text).

    ``spans`` lists the removed runs as start:end in bytes. ``length`` is 100 or more; 2 ** ``blocks_log`` blocks are
    sorted one after the other.
    """
    if length < PERIOD + 16:
        raise ValueError(f"strings of {PERIOD + 16} bytes or more")
    width = length - PERIOD + 1
    spark, tiles = docs.sparkSession, _tiles(docs)
    _free(spark)
    copies = _copies(tiles)
    size = tiles.select(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    bits = max(5, int(np.ceil(np.log2(max(1, size * len(COVER) / PERIOD / BUCKET_KEYS)))))
    repeated = _repeated_samples(tiles, copies, width, bits)
    _free(spark)
    runs = _candidates(tiles, copies, repeated, length, width)
    _free(spark)
    later = []
    for block in range(1 << blocks_log):
        later.append(_later_suffixes(tiles, runs, length, bits + blocks_log, block, blocks_log))
        _free(spark)
    answers = later[0]
    for x in later[1:]:
        answers = answers.union(x)
    answers = answers.groupBy("tile").agg(F.collect_list(F.struct("block", "answers")).alias("blocks"))

    def finish(row: dict) -> list:
        tile, by_block = Tile(row, row["copies"]), {b["block"]: b["answers"] for b in row["blocks"] or ()}
        at = [np.empty(0, np.int64)]
        for block in range(1 << blocks_log):
            found = Block(tile.data, row["low"], row["high"], length, block, blocks_log)
            at.append(found.repeats(_answered(by_block.get(block), len(found.ranks.keys))))
        at = np.sort(np.concatenate(at))
        doc = np.searchsorted(tile.starts, at, "right") - 1
        spans: dict[int, list] = {}
        if len(at):
            begins = np.flatnonzero(np.concatenate([[True], (np.diff(at) > length) | (np.diff(doc) > 0)]))
            last = at[np.append(begins[1:], len(at)) - 1] + length
            for d, low, high in zip(doc[begins].tolist(), at[begins].tolist(), last.tolist(), strict=True):
                spans.setdefault(d, []).append((low, high))
        for d in np.flatnonzero(tile.copy & (tile.lengths >= length)).tolist():
            spans[d] = [(int(tile.starts[d]), int(tile.ends[d]))]
        return [_cut_out(tile, d, spans.get(d, [])) for d in range(len(tile.lengths))]

    joined = tiles.join(copies, "tile", "left").join(runs, "tile").join(answers, "tile", "left")
    return _per_tile(joined, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string")
