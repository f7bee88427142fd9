"""Merkle manifest of a table, kept as a log of nodes in the order of their completion.

Leaves stand in order inside their group (a source, a partition). Every ``ARITY`` consecutive nodes of a level, the last
run may be shorter, become their parent, until one is left: the group's subroot. Subroots, in the order of the groups,
become the root in the same way.

Builders are aligned: one takes ``ARITY ** HEIGHT`` consecutive leaves, so its nodes form one subtree and follow each
other in the log. The roots of such subtrees are the leaves of the next stage's builders. A node's place in the log
follows from the leaves before it: ``j`` leaves complete ``j // ARITY ** l`` nodes of level ``l``. So siblings are
addressed by arithmetic, inside a builder's segment as in the whole log, and no node is searched for.

Defined results: NULL values hash as ``-``, other values with their length, so NULL, empty and "-" differ. Leaves of one
group are ordered by the given columns, NULLs first, then by their digest; equal rows are leaves of their own. A group of
one leaf has that leaf as subroot, and one subroot is the root. An empty table has no rows, groups or root. Further
columns of the rows may have any names; those to be kept are given in ``carry``. Texts of any length are hashed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from sightline.operators.ordinals import dense_position
from sightline.session import cut

ARITY = 3
#: Levels that one builder completes; it holds ARITY ** HEIGHT leaves.
HEIGHT = 6


def row_digest(*values: Column) -> Column:
    """Digest of a row: each value as ``-`` if it is NULL, else as its UTF-8 length, ``:`` and itself."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _parent(nodes: Sequence[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def append_log(leaves: Sequence[str], height: int) -> list[str]:
    """Nodes over ``leaves`` up to level ``height`` in the order of their completion."""
    log: list[str] = []
    runs: list[list[str]] = [[] for _ in range(height + 1)]

    def close(level: int) -> None:
        node = _parent(runs[level])
        runs[level].clear()
        runs[level + 1].append(node)
        log.append(node)

    for leaf in leaves:
        log.append(leaf)
        runs[0].append(leaf)
        level = 0
        while level < height and len(runs[level]) == ARITY:
            close(level)
            level += 1
    for level in range(height):  # what the end of the leaves leaves open
        if runs[level]:
            close(level)
    return log


def position(level: int, i: int, leaves: int) -> int:
    """Place in the log of node ``i`` of ``level`` in a tree of so many leaves."""
    last = min((i + 1) * ARITY**level, leaves) - 1
    place, power = last + level, ARITY
    while power <= last:
        place += last // power
        power *= ARITY
    return place


def paths(log: Sequence[str], leaves: int, height: int) -> list[list[str]]:
    """For each leaf and level the siblings before and after the node above the leaf, joined: before, after, before, ..."""
    sides: list[list[tuple[str, str]]] = []
    count = leaves
    for level in range(height):
        level_sides = []
        for first in range(0, count, ARITY):
            run = [log[position(level, i, leaves)] for i in range(first, min(first + ARITY, count))]
            level_sides += [("".join(run[:k]), "".join(run[k + 1:])) for k in range(len(run))]
        sides.append(level_sides)
        count = -(-count // ARITY)
    return [[x for level in range(height) for x in sides[level][leaf // ARITY**level]] for leaf in range(leaves)]


def _levels(n: int) -> int:
    """Levels above so many leaves."""
    level = 0
    while ARITY**level < n:
        level += 1
    return level


def _segments(items: DataFrame, height: int) -> DataFrame:
    """One builder's work per row: (tree, n, block, last, height, items, log); ``items`` has (tree, n, at, digest, carry)."""
    per = ARITY**height
    item = items.select("at", "digest", "carry").schema.simpleString()

    def build(leaves: pa.Table) -> pa.Table:
        leaves = leaves.sort_by("at")
        n = leaves["n"][0].as_py()
        levels = _levels(n) if n <= per else height
        log = append_log(leaves["digest"].to_pylist(), levels)
        rows = leaves.select(["at", "digest", "carry"]).to_struct_array().combine_chunks()
        one = {"tree": leaves["tree"][:1], "n": leaves["n"][:1], "block": leaves["block"][:1], "last": [n <= per], "height": pa.array([levels], pa.int32())}
        return pa.table(one | {"items": pa.ListArray.from_arrays([0, len(rows)], rows), "log": [log]})

    made = items.withColumn("block", F.floor(F.col("at") / per)).groupBy("tree", "block")
    return cut(made.applyInArrow(build, f"tree long, n long, block long, last boolean, height int, items array<{item}>, log array<string>"))


def _stages(items: DataFrame, longest: int, height: int) -> list[DataFrame]:
    """Segments of the leaves, then of the subtrees' roots, and so on; ``longest`` is the largest number of leaves of a tree."""
    per, out = ARITY**height, [_segments(items, height)]
    while longest > per:
        longest = -(-longest // per)
        roots = out[-1].where(~F.col("last")).select(
            "tree", F.ceil(F.col("n") / per).alias("n"), F.col("block").alias("at"), F.element_at("log", -1).alias("digest"), F.lit(None).cast("int").alias("carry"))
        out.append(_segments(roots, height))
    return out


def _prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments with the path of their own root to a row per leaf."""
    for batch in batches:
        for r in range(batch.num_rows):
            row = batch.slice(r, 1)
            items, above = row["items"].flatten(), row["path"][0].as_py()
            local = paths(row["log"][0].as_py(), len(items), row["height"][0].as_py())
            each = {c: pa.repeat(row[c][0], len(items)) for c in ("tree", "subroot", "root")}
            whole = {"path": pa.array([p + above for p in local], pa.list_(pa.string()))}
            yield pa.RecordBatch.from_pydict({"tree": each["tree"], **{c: items.field(c) for c in ("at", "digest", "carry")}, **whole, "subroot": each["subroot"], "root": each["root"]})


def _proved(stages: list[DataFrame], roots: DataFrame) -> DataFrame:
    """(tree, at, digest, carry, path, subroot, root) of every leaf; ``roots`` has (tree, path, subroot, root) of every tree.

    Paths are handed down: each builder knows the path of its own root and adds its segment's part. So a builder meets
    one row per subtree below it, however many leaves a tree has.
    """
    found = None
    for stage in reversed(stages):
        above = stage.where("last").select("tree", "block").join(roots, "tree").select("tree", "block", "path", "subroot", "root")
        if found is not None:
            above = above.unionByName(found.select("tree", F.col("at").alias("block"), "path", "subroot", "root"))
        carry = stage.select(F.explode("items").alias("x")).select("x.carry").schema["carry"].dataType.simpleString()
        found = stage.join(above, ["tree", "block"]).mapInArrow(_prove, f"tree long, at long, digest string, carry {carry}, path array<string>, subroot string, root string")
    return found


def folded(leaf: Column, path: Column) -> Column:
    """Root that a leaf and its path lead to."""
    steps = F.sequence(F.lit(0), F.floor(F.size(path) / 2).cast("int") - 1)
    up = F.aggregate(steps, leaf, lambda node, i: F.sha2(F.concat(F.get(path, 2 * i), node, F.get(path, 2 * i + 1)), 256))
    return F.when(F.size(path) == 0, leaf).otherwise(up)


@dataclass
class Manifest:
    """Groups (their columns, tree, n) in order, and the stored segments of their logs and of the log above them."""

    groups: DataFrame
    stages: list[DataFrame]
    upper: list[DataFrame]
    height: int

    def log(self) -> DataFrame:
        """(tree, position, node) of each group's log. A node keeps its place when leaves are added behind it."""
        parts = []
        for s, stage in enumerate(self.stages):
            places = _places(F.lit(s), F.lit(self.height), "block", F.size("items"), "height", "leaves")
            sized = stage.join(self.groups.select("tree", F.col("n").alias("leaves")), "tree")
            parts.append(sized.select("tree", F.explode(F.arrays_zip(places.alias("position"), F.col("log").alias("node"))).alias("x")).select("tree", "x.*"))
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return whole.where("position >= 0")

    def proofs(self) -> DataFrame:
        """(tree, at, digest, carry, path, subroot, root) of every leaf."""
        top = self.upper[-1].where("last").select("tree", F.array().cast("array<string>").alias("path"), F.lit(None).cast("string").alias("subroot"), F.element_at("log", -1).alias("root"))
        ends = _proved(self.upper, top)
        return _proved(self.stages, ends.select(F.col("carry").alias("tree"), "path", F.col("digest").alias("subroot"), "root"))


@F.pandas_udf(ArrayType(LongType()))
def _places(stage: pd.Series, per: pd.Series, block: pd.Series, items: pd.Series, height: pd.Series, leaves: pd.Series) -> pd.Series:
    """Places in the whole log of a segment's nodes; -1 for those that the stage below has written."""
    out = []
    for s, h, b, n, levels, total in zip(stage, per, block, items, height, leaves):
        places, count = {}, n
        for level in range(levels + 1):
            for i in range(count):
                whole = position(s * h + level, b * ARITY ** (h - level) + i, total)
                places[position(level, i, n)] = whole if level or not s else -1
            count = -(-count // ARITY)
        out.append([places[i] for i in range(len(places))])
    return pd.Series(out, dtype=object)


def build(rows: DataFrame, digest: Column, by: list[str], order: list[str], carry: list[Column], height: int = HEIGHT) -> Manifest:
    """Manifest of ``rows``, grouped by the columns ``by`` and ordered by ``order``, then by ``digest``.

    One range sort numbers all leaves, so a group may hold any share of the rows.
    """
    columns = {f"_by{i}": F.col(f"`{c}`") for i, c in enumerate(by)}
    orders = {f"_order{i}": F.col(f"`{c}`") for i, c in enumerate(order)}
    named = [c.alias(k) for k, c in {**columns, **orders}.items()]
    leaves = rows.select(*named, digest.alias("digest"), F.struct(*carry).alias("carry"), F.monotonically_increasing_id().alias("_tie"))
    placed = dense_position(leaves, [F.col(c) for c in (*columns, *orders, "digest", "_tie")], "_pos")
    groups = cut(placed.groupBy(*columns).agg(F.min("_pos").alias("tree"), F.count(F.lit(1)).alias("n")))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"g.{c}")) for c in columns]
    items = placed.alias("r").join(groups.alias("g"), same).select("tree", "n", (F.col("_pos") - F.col("tree")).alias("at"), "digest", "carry")
    longest, trees = groups.agg(F.max("n"), F.count(F.lit(1))).first()
    stages = _stages(items, longest or 0, height)
    ends = None
    for stage in stages:
        end = stage.where("last").select("tree", F.element_at("log", -1).alias("digest"))
        ends = end if ends is None else ends.unionByName(end)
    numbered = dense_position(ends, [F.col("tree")], "at")
    upper = numbered.select(F.lit(0).cast("long").alias("tree"), F.lit(trees).cast("long").alias("n"), "at", "digest", F.col("tree").alias("carry"))
    names = [F.col(f"_by{i}").alias(c) for i, c in enumerate(by)]
    return Manifest(groups.select(*names, "tree", "n"), stages, _stages(upper, trees, height), height)
