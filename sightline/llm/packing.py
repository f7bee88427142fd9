"""Best-fit packing whose number of sequences is certified by lower bounds.

Pieces are dealt over partitions and packed best-fit decreasing in each. Dual feasible functions then give a number of
sequences that no packing of the same pieces can go below. A partition that meets it is done. One that doesn't keeps its
full sequences and gives up the pieces of the others; the pieces of all such partitions are dealt out anew, so they meet
other lengths, and packed again.

A partition holds a bounded number of pieces whatever the size of the input. Documents longer than a sequence are cut;
pieces of full length are sequences of their own and are not packed.

Defined results: NULL and empty texts have the end id only; rows that repeat are packed each by itself; an empty table
gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.tokens import batches, encoder
from sightline.session import cut


#: Letters of one call of the encoder, about: it looks up each distinct word once per call.
CALL_LETTERS = 24_000_000


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole capacities, with the shorter piece first."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((a, capacity) for a in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids and the end id."""
    def of(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), end_id.to_bytes(4, "little")
        for b in stream:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for part in batches(texts, CALL_LETTERS):
                at, rows = [], []
                for i, ids in enumerate(enc.encode(texts[part]), part.start):
                    full = np.frombuffer(ids, enc.dtype).astype("<u4").tobytes() + end
                    for k, (start, n) in enumerate(cut_points(len(full) // 4, capacity)):
                        at.append(i)
                        rows.append((k, start, n, crc32(full[4 * start : 4 * (start + n)])))
                k, start, n, crc = zip(*rows, strict=True)
                columns = [b.column(0).take(pa.array(at)), pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(of, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def least_bins(lengths: np.ndarray, capacity: int, steps: int = 40) -> int:
    """The best lower bound of two families of dual feasible functions.

    One counts lengths above capacity - t as whole, drops those below t and keeps the others, for every t up to half the
    capacity. The other rounds (k + 1) * length / capacity down to k-ths, and leaves exact multiples as they are.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    mass = count * np.arange(capacity + 1)
    above, held = np.cumsum(count[::-1])[::-1], np.concatenate([[0], np.cumsum(mass)])
    t = np.arange(0, capacity // 2 + 1)
    whole = np.where(t > 0, above[np.minimum(capacity - t + 1, capacity)], 0)
    best = int((whole + -(-(held[capacity - t + 1] - held[t]) // capacity)).max())
    x = np.arange(capacity + 1)
    for k in range(1, steps):
        scaled = np.where((k + 1) * x % capacity == 0, x * k, (k + 1) * x // capacity * capacity)  # in k-ths of the capacity
        best = max(best, -(-int((count * scaled).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length, and what each bin holds; longest first, each into the fullest bin it fits."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, left = 0, []  # bit r of rooms: some bin has room for exactly r
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(left)
            left.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        left[b] = room - n
        by_room[room - n].append(b)
        if room > n:
            rooms |= 1 << (room - n)
    return bins, offsets, capacity - np.array(left, np.int64)


_PACKED = "_part long, _bin long, offset long, open boolean"


def _pack_parts(rows: DataFrame, capacity: int) -> DataFrame:
    """Packs each ``_part`` of rows (__row, length, _part); adds bin, offset and whether the bin is given up."""
    def of(group: pd.DataFrame) -> pd.DataFrame:
        lengths = group["length"].to_numpy()
        bins, offsets, held = best_fit(lengths, capacity)
        gap = len(held) > least_bins(lengths, capacity)
        return group[["__row", "length", "_part"]].assign(_bin=bins, offset=offsets, open=gap & (held[bins] < capacity))

    return rows.groupBy("_part").applyInPandas(of, f"__row long, length long, {_PACKED}")


def pack(items: DataFrame, capacity: int = 2048, per_part: int = 20_000, rounds: int = 4) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length`` from 1 to ``capacity``.

    ``per_part`` bounds the pieces of one partition, ``rounds`` the exchanges; after the last one, what is packed stays.
    """
    items = cut(items.withColumn("__row", F.monotonically_increasing_id()))
    waiting, done = items.where(F.col("length") < capacity).select("__row", "length"), []
    for k in range(rounds):
        n = waiting.count()
        if not n:
            break
        parts = -(-n // per_part)
        packed = cut(_pack_parts(waiting.withColumn("_part", F.pmod(F.xxhash64(F.lit(k), "__row"), F.lit(parts))), capacity))
        last = k == rounds - 1 or parts == 1
        closed = packed if last else packed.where(~F.col("open"))
        done.append(closed.select("__row", "offset", (F.lit(k << 58) + F.shiftleft("_part", 20) + F.col("_bin")).alias("sequence_id")))
        if last:
            break
        waiting = packed.where("open").select("__row", "length")
    full = items.where(F.col("length") == capacity).select("__row", F.lit(0).cast("long").alias("offset"), (-1 - F.col("__row")).alias("sequence_id"))
    for d in done:
        full = full.union(d)
    return items.join(full, "__row").drop("__row")
