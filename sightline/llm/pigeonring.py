"""SimHash near-duplicates, found by pigeonring filtering.

A fingerprint is a ring of four segments. If two fingerprints differ in three bits at most, then from some segment on,
every chain of l neighbouring segments differs in l * 3 / 4 bits at most: none in the first, one in the first two, two
in the first three. Pairs are looked up by the first two segments of such a chain: the first as it is, the second as it
is or with one of its zero bits set. That gives a key of 32 bits; the longer chains and then the full distance are
checked on the pairs that meet.

Copies share a fingerprint and are represented by it, so a group of copies costs one row. Keys that very many distinct
fingerprints share are settled without pairs: each fingerprint visits the values around it, and whoever comes within two
bits of a value that somebody else is within one bit of is linked with that one. Both are then within three bits, and
any two within three bits meet at a value in between.

Defined results: NULL and wordless texts have fingerprint 0 and are linked like any others; NULL ids have a component
too, named by the smallest id in it that is not NULL; rows that repeat are rows of one fingerprint; an empty table gives
an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.graph import components
from sightline.session import cut

SEGMENTS, BITS, DISTANCE = 4, 16, 3
_CHUNK = 65_536


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Bit b is set if it is set in over half of the hashes of all shingles, repeats included."""
    w = (text or "").encode().lower().split()  # of bytes: A-Z and ASCII white space only
    if not w:
        return 0
    n, ones = max(1, len(w) - words + 1), np.zeros(64, np.int64)
    for a in range(0, n, _CHUNK):
        hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + words]), seed) for i in range(a, min(n, a + _CHUNK))]
        ones += np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) of every document; ``fp`` is the fingerprint as a signed long."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t.as_py(), words) for t in b.column(1)], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found)], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(of, f"doc_id {kind}, fp long")


def _ring(fp: Column, i: int) -> Column:
    """The ring turned so that segment i comes first, in the lowest bits."""
    return fp if i == 0 else F.shiftrightunsigned(fp, BITS * i).bitwiseOR(F.shiftleft(fp, 64 - BITS * i))


def _keys(prints: DataFrame) -> DataFrame:
    """(i, key, fp): for each start i, the first two segments."""
    turns = F.array(*[F.struct(F.lit(i).alias("i"), _ring(F.col("fp"), i).bitwiseAND(F.lit(0xFFFFFFFF)).alias("key")) for i in range(SEGMENTS)])
    return prints.select(F.explode(turns).alias("turn"), "fp").select("turn.i", "turn.key", "fp")


def _probes(keys: DataFrame) -> DataFrame:
    """The keys themselves, and those with one zero bit of the second segment set: each pair is met from one side."""
    bits = F.filter(F.array(*[F.lit(1 << b) for b in range(BITS, 2 * BITS)]), lambda b: F.col("key").bitwiseAND(b) == 0)
    return keys.select("i", "key", F.col("fp").alias("other"), F.lit(False).alias("set")).union(
        keys.select("i", "key", "fp", F.explode(bits).alias("bit")).select("i", F.col("key").bitwiseOR(F.col("bit")), "fp", F.lit(True))
    )


def _close(i: Column, a: Column, b: Column) -> Column:
    """The chain of three segments from i on, and the whole ring, stay within their budgets."""
    x = a.bitwiseXOR(b)
    chain = F.when(i == 0, _ring(x, 0)).when(i == 1, _ring(x, 1)).when(i == 2, _ring(x, 2)).otherwise(_ring(x, 3))
    return (F.bit_count(chain.bitwiseAND(F.lit((1 << 3 * BITS) - 1))) <= 3 * DISTANCE // SEGMENTS) & (F.bit_count(x) <= DISTANCE)


def _visits(prints: DataFrame, masks: list[int]) -> DataFrame:
    return prints.select("fp", F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("at"))


def links_through_values(prints: DataFrame) -> DataFrame:
    """Links (a, b) within three bits that connect whatever is connected among ``prints`` (fp), without pairs."""
    ones = [_signed(1 << b) for b in range(64)]
    near = _visits(prints, [0, *ones])
    host = near.groupBy("at").agg(F.min("fp").alias("host"))
    first = prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("p"))
    far = first.select("fp", "p", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("q")).where("p < q")
    bit = lambda c: F.expr(f"shiftleft(1L, {c})")
    two = far.select("fp", F.col("fp").bitwiseXOR(bit("p").bitwiseOR(bit("q"))).alias("at"))
    return near.union(two).join(host, "at").where("fp <> host").select(F.col("fp").alias("a"), F.col("host").alias("b")).distinct()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame, crowd: int = 256) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``prints`` (fp) that differ in three bits at most.

    All such pairs, but for keys that more than ``crowd`` fingerprints share: there the links connect the same
    components without naming every pair.
    """
    keys = _keys(prints)
    crowded = cut(keys.groupBy("i", "key").count().where(F.col("count") > crowd).select("i", "key"))
    probes, found = _probes(keys), []
    if not crowded.isEmpty():
        inside = probes.join(crowded, ["i", "key"], "left_semi").select(F.col("other").alias("fp")).distinct()
        found.append(links_through_values(cut(inside)))
        keys, probes = (x.join(crowded, ["i", "key"], "left_anti") for x in (keys, probes))
    pairs = probes.join(keys, ["i", "key"]).where((F.col("set") | (F.col("other") < F.col("fp"))) & _close(F.col("i"), F.col("other"), F.col("fp")))
    found.append(pairs.select(F.col("other").alias("a"), F.col("fp").alias("b")))
    return found[0] if len(found) == 1 else found[0].union(found[1])


def near_duplicates(docs: DataFrame, words: int = 3, crowd: int = 256) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs`` (doc_id, text)."""
    printed = cut(fingerprints(docs, words))
    distinct = cut(printed.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct.select("fp"), crowd)).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return printed.join(rooted.join(names, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
