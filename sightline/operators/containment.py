"""Texts that another text of their group contains, without comparing all pairs.

A text is known by some of its short pieces: of every stretch of ``least`` letters the piece with the smallest hash. A
text that lies inside another has all its stretches there too, so each of its pieces is a piece of the other. A text
looks for the one of its pieces that the fewest texts of its group have; only those are compared letter by letter.

Short texts need short stretches, which are many. A group is cut into stretches of a length only if some text of the
group is of that length's class. Groups of few texts and letters are not cut: there each text is looked for in the
earlier ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.session import cut

#: Classes of texts: the least length, and the length of a piece, a power of two.
CLASSES = [(1, 1), (8, 4), *((n, min(64, n // 4)) for n in (16, 32, 64, 128, 256, 512, 1024, 2048, 4096))]
#: Most texts, and most letters of all of them, of a group that is not cut.
FEW, FEW_LETTERS = 16, 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 1 << 18


def pieces(text: str, least: int, size: int) -> np.ndarray:
    """Hashes of the pieces of ``size`` letters that some stretch of ``least`` letters is known by."""
    letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    wide, found = least - size + 1, []
    for lo in range(0, max(0, len(letters) - least + 1), _BLOCK):  # a stretch belongs to the block it starts in
        part = letters[lo:lo + _BLOCK + least - 1].astype(np.uint64)
        h, have, power = part + np.uint64(1), 1, int(_BASE)
        while have < size:  # sizes are powers of two: two halves make a piece
            h = h[:-have] * np.uint64(power) + h[have:]
            have, power = have * 2, power * power % (1 << 64)
        h = (h ^ (h >> np.uint64(29))) * _BASE
        h ^= h >> np.uint64(32)
        # smallest of every ``wide`` neighbours, doubling the reach
        reach, low = 1, h
        while reach * 2 <= wide:
            low, reach = np.minimum(low[:-reach], low[reach:]), reach * 2
        rest = wide - reach
        found.append(np.unique(np.minimum(low[:len(low) - rest], low[rest:]) if rest else low))
    return np.unique(np.concatenate(found)).view(np.int64) if found else np.zeros(0, np.int64)


def _class(text: Column) -> Column:
    out = F.lit(0)
    for i, (least, _) in enumerate(CLASSES):
        out = F.when(F.length(text) >= least, i).otherwise(out)
    return out


def _cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: list[list[np.ndarray]] = [[], [], [], [], []]
        size = 0
        for text_id, group, part, own, kinds in zip(*(batch[c].to_pylist() for c in ("id", "group", "part", "own", "kinds"))):
            for kind in kinds:
                found = pieces(part, *CLASSES[kind])
                size += len(found)
                for column, x in zip(columns, (text_id, group, np.int32(kind), found, kind == own)):
                    column.append(x if x is found else np.full(len(found), x))
            if size > _BLOCK:
                yield _rows(columns)
                columns, size = [[], [], [], [], []], 0
        if size:
            yield _rows(columns)


def _rows(columns: list[list[np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["id", "group", "kind", "piece", "own"])


def contained(texts: DataFrame, by: list[str], order: Column) -> DataFrame:
    """(id) of the rows of ``texts`` (id, part, and the columns ``by``) whose part lies in one of an earlier row of their group.

    ``texts`` must be stored: it is read several times. Parts of a group are distinct and not empty.
    """
    group = F.xxhash64(*by)  # groups that share a hash are told apart when texts are compared
    rows = texts.select("id", group.alias("group"), "part", _class(F.col("part")).alias("own"))
    # stored, so that its size decides whether the texts must be moved to meet it
    sizes = cut(rows.groupBy("group").agg(
        F.collect_set("own").alias("kinds"), F.count(F.lit(1)).alias("n"), F.sum(F.length("part")).alias("letters"),
    ).where("n > 1").select("group", "kinds", ((F.col("n") <= FEW) & (F.col("letters") <= FEW_LETTERS)).alias("few")))
    among_few = _among_few(texts.withColumn("group", group).join(sizes.where("few").select("group"), "group"), by, order)
    kinds = sizes.where("NOT few").drop("few")
    cut_up = rows.join(kinds, "group").mapInArrow(_cut_up, "id long, group long, kind int, piece long, own boolean")
    known = cut(cut_up)
    spread = known.groupBy("group", "kind", "piece").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    asked = known.where("own").join(spread, ["group", "kind", "piece"], "left")
    # the rarest piece; a text with a piece of its own lies in no other
    rarest = asked.groupBy("id", "group", "kind").agg(F.min(F.struct(F.coalesce("n", F.lit(1)).alias("n"), "piece")).alias("r")).where("r.n > 1")
    pairs = cut(rarest.select(F.col("id").alias("inner"), "group", "kind", F.col("r.piece").alias("piece")).join(
        known.select("id", "group", "kind", "piece"), ["group", "kind", "piece"]).where("id <> inner").select("inner", F.col("id").alias("outer")))
    whole = texts.select("id", F.struct(*by).alias("g"), order.alias("o"), "part")
    a = whole.select(*[F.col(c).alias(f"a_{c}") for c in whole.columns])
    b = whole.select(*[F.col(c).alias(f"b_{c}") for c in whole.columns])
    met = pairs.join(a, F.col("inner") == F.col("a_id")).join(b, F.col("outer") == F.col("b_id"))
    inside = (F.col("b_o") < F.col("a_o")) & F.col("a_g").eqNullSafe(F.col("b_g")) & F.contains("b_part", "a_part")
    # stored, so that its size decides whether texts must be moved to meet it
    return cut(met.where(inside).select(F.col("inner").alias("id")).distinct().union(among_few))


def _among_few(texts: DataFrame, by: list[str], order: Column) -> DataFrame:
    """(id) of the texts that an earlier one of their small group contains."""
    groups = texts.groupBy("group", *by).agg(F.collect_list(F.struct(order.alias("o"), "part", "id")).alias("all"))
    inner = F.filter("all", lambda x: F.exists("all", lambda y: (y["o"] < x["o"]) & F.contains(y["part"], x["part"])))
    return groups.select(F.explode(F.transform(inner, lambda x: x["id"])).alias("id"))
