"""Lines that repeat across documents, found by minimal perfect hashes of the distinct lines.

A line is known by the 128-bit hash of its key. Distinct hashes are counted and dealt to shards; each shard numbers its
hashes by a minimal perfect hash and keeps, at these numbers, three flat arrays: a 32-bit fingerprint, the number of
documents and the smallest document id. A shard is one row of a table. Documents send it 16 bytes per line and look
them up in the arrays; lines and texts never meet each other.

Defined results: a NULL or empty text is one empty line. Rows are told apart by ``doc_id``; rows with one id are one
document, rows without an id are one document that comes last. A key's document with the smallest id keeps all its
lines with that key, however often it repeats there. Empty tables give empty results, further columns are ignored.
Two keys with one 128-bit hash would be taken for one (10^12 distinct lines: about 10^-15). A line that the index has
never seen is told by its fingerprint, and taken for one it knows with a chance of 2^-32; lines of the indexed documents
are always there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.arrays import bind
from sightline.session import cut

BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Code points of the shortest line that counts.
SHORTEST = 10
#: Lines per shard, and lines that one task looks up.
SHARD_LINES = 1 << 18
PROBE_LINES = 1 << 20
_LAST_ID = (1 << 63) - 1
_ROOM = 2  # slots per key on each level of the hash
_LEVELS = 40


def line_hashes(text: bytes, shortest: int = SHORTEST) -> dict[bytes, list[int]]:
    """Positions of each key that counts, by the key's hash."""
    found: dict[bytes, list[int]] = {}
    for at, line in enumerate(text.split(b"\n")):
        key = line.strip(BLANK).lower()  # of bytes: A-Z only
        if len(key) >= 4 * shortest or len(key) >= shortest and len(key.decode("utf-8", "replace")) >= shortest:
            found.setdefault(xxhash.xxh3_128_digest(key), []).append(at)
    return found


# ---- minimal perfect hash ------------------------------------------------------------------


def _slots(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    x = h1 ^ (h2 * np.uint64(2 * level + 1) + np.uint64(0x9E3779B97F4A7C15 * (level + 1) & 0xFFFFFFFFFFFFFFFF))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)  # constants of a public 64-bit mixer
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Numbers 0 to n - 1 of n distinct 128-bit keys.

    On each level a key takes its slot if no other key of the level wants it; the rest goes on to the next. A key's
    number is the number of taken slots before its own. Keys that no level parts are listed.
    """

    def __init__(self, sizes: np.ndarray, taken: np.ndarray, rest: np.ndarray):
        self.sizes, self.taken, self.rest = sizes, taken, rest
        self._bits = np.unpackbits(taken, count=int(sizes.sum())).astype(bool)
        self._before = np.cumsum(self._bits, dtype=np.int64) - self._bits
        self._placed = int(self._bits.sum())

    @classmethod
    def over(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        sizes, bits = [], []
        for level in range(_LEVELS):
            if not len(h1):
                break
            size = max(8, _ROOM * len(h1))
            slots = _slots(h1, h2, level, size)
            alone = np.bincount(slots, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            left = ~alone[slots]
            h1, h2 = h1[left], h2[left]
        taken = np.packbits(np.concatenate(bits)) if bits else np.zeros(0, np.uint8)
        return cls(np.array(sizes, np.int64), taken, np.stack([h1, h2], axis=1) if len(h1) else np.zeros((0, 2), np.uint64))

    def numbers(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Numbers of keys; of a key that isn't there any number, or -1."""
        out = np.full(len(h1), -1, np.int64)
        open_, start = np.arange(len(h1)), 0
        for level, size in enumerate(self.sizes):
            at = start + _slots(h1[open_], h2[open_], level, int(size))
            hit = self._bits[at]
            out[open_[hit]] = self._before[at[hit]]
            open_, start = open_[~hit], start + int(size)
        for i, key in enumerate(self.rest):
            out[open_[(h1[open_] == key[0]) & (h2[open_] == key[1])]] = self._placed + i
        return out


# ---- index ---------------------------------------------------------------------------------


def _unsigned(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().view(np.uint64)


_INDEX = "shard long, n_keys long, n_lines long, sizes binary, taken binary, rest binary, fingerprints binary, counts binary, firsts binary"


def _build(key: tuple, keys: pa.Table) -> pa.Table:
    """Arrays of one shard from its (h1, h2, n, first)."""
    h1, h2 = _unsigned(keys["h1"]), _unsigned(keys["h2"])
    hashed = PerfectHash.over(h1, h2)
    order = np.empty(len(h1), np.int64)
    order[hashed.numbers(h1, h2)] = np.arange(len(h1))
    n, first = keys["n"].to_numpy(), keys["first"].to_numpy()
    arrays = {
        "sizes": hashed.sizes, "taken": hashed.taken, "rest": hashed.rest, "fingerprints": h2[order].astype(np.uint32),
        "counts": np.minimum(n[order], 0xFFFFFFFF).astype(np.uint32), "firsts": first[order],
    }
    return pa.table({"shard": [key[0].as_py()], "n_keys": [len(h1)], "n_lines": [int(n.sum())], **{k: pa.array([v.tobytes()], pa.binary()) for k, v in arrays.items()}})


class Shard:
    """Arrays of one row of an index."""

    def __init__(self, row: dict):
        kinds = {"sizes": np.int64, "taken": np.uint8, "rest": np.uint64, "fingerprints": np.uint32, "counts": np.uint32, "firsts": np.int64}
        a = {k: np.frombuffer(row[k], t) for k, t in kinds.items()}
        self.hashed = PerfectHash(a["sizes"], a["taken"], a["rest"].reshape(-1, 2))
        self.fingerprints, self.counts, self.firsts = a["fingerprints"], a["counts"], a["firsts"]

    def look_up(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of documents and smallest id of each key; 0 and the last id of a key that isn't there."""
        counts, firsts = np.zeros(len(h1), np.int64), np.full(len(h1), _LAST_ID)
        if not len(self.counts):
            return counts, firsts
        at = self.hashed.numbers(h1, h2)
        there = (at >= 0) & (self.fingerprints[at] == h2.astype(np.uint32))
        counts[there], firsts[there] = self.counts[at[there]], self.firsts[at[there]]
        return counts, firsts


def document_lines(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, t1, t2, h1, h2, at): a row per document and distinct line that counts, with the line's positions.

    ``t1`` and ``t2`` hash the whole text; with the id they stand for the row. The result is stored.
    """
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hashes, places = [], [], []
            for r, text in enumerate(batch["text"].cast(pa.binary()).to_pylist()):
                found = line_hashes(text, shortest)
                rows += [r] * len(found)
                hashes += found.keys()
                places += found.values()
            h = np.frombuffer(b"".join(hashes), "<u8").reshape(-1, 2).astype(np.uint64).view(np.int64)
            own = batch.select(["doc_id", "t1", "t2"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(places, pa.list_(pa.int32()))], ["doc_id", "t1", "t2", "h1", "h2", "at"])

    return cut(_rows(docs).mapInArrow(parse, "doc_id long, t1 long, t2 long, h1 long, h2 long, at array<int>"))


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce("doc_id", F.lit(_LAST_ID)).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))


def _shard(shards: int) -> Column:
    return F.pmod("h1", F.lit(shards)).cast("long")


def index(lines: DataFrame, shards: int) -> DataFrame:
    """One row of arrays per shard. Lines are counted before they are dealt, so a line in every document is one row."""
    keys = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    return cut(keys.withColumn("shard", _shard(shards)).groupBy("shard").applyInArrow(_build, _INDEX))


def probe(lines: DataFrame, indexed: DataFrame, shards: int, probe_lines: int = PROBE_LINES) -> DataFrame:
    """``lines`` that stand in a document with a smaller id. Shards that more than ``probe_lines`` ask are copied for parts of them."""
    parts = indexed.select("shard", F.ceil(F.col("n_lines") / probe_lines).alias("parts"))
    crowded = cut(parts.where("parts > 1"))
    asked = lines.withColumn("shard", _shard(shards)).join(crowded, "shard", "left")
    asked = asked.select("shard", F.pmod(F.xxhash64("doc_id", "t1"), F.coalesce("parts", F.lit(1))).alias("part"), "doc_id", "t1", "t2", "h1", "h2", "at")
    held = indexed.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")

    def look(key: tuple, rows: pa.Table, arrays: pa.Table) -> pa.Table:
        rows = rows.select(["doc_id", "t1", "t2", "at"]).append_column("h1", rows["h1"]).append_column("h2", rows["h2"])
        if not rows.num_rows or not arrays.num_rows:
            return rows.slice(0, 0).select(["doc_id", "t1", "t2", "at"])
        counts, firsts = Shard(arrays.to_pylist()[0]).look_up(_unsigned(rows["h1"]), _unsigned(rows["h2"]))
        again = (counts >= 2) & (rows["doc_id"].to_numpy() > firsts)
        return rows.select(["doc_id", "t1", "t2", "at"]).filter(pa.array(again))

    return asked.groupBy("shard", "part").cogroup(held.groupBy("shard", "part")).applyInArrow(look, "doc_id long, t1 long, t2 long, at array<int>")


def drop_repeated_lines(docs: DataFrame, shortest: int = SHORTEST, shard_lines: int = SHARD_LINES, probe_lines: int = PROBE_LINES) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) of every row: its lines but those with a key that a document with a smaller id holds."""
    lines = document_lines(docs, shortest)
    shards = max(1, -(-lines.count() // shard_lines))
    repeated = probe(lines, index(lines, shards), shards, probe_lines)
    dropped = repeated.groupBy("doc_id", "t1", "t2").agg(F.flatten(F.collect_set("at")).alias("dropped"))  # equal rows drop the same lines
    rows = _rows(docs).join(dropped, ["doc_id", "t1", "t2"], "left")

    def kept(parts: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("dropped"))
        text = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n"))
        return F.struct(F.size(parts).cast("long").alias("n_lines"), text.alias("text"))

    made = rows.select("doc_id", F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), bind(F.split("text", "\n"), kept).alias("x"))
    return made.select(F.nullif("doc_id", F.lit(_LAST_ID)).alias("doc_id"), "x.n_lines", "n_dropped", "x.text")
