"""A Merkle manifest of a dataset: leaves by row, a tree for each source, a tree over the sources.

A node's hash is the SHA-256, in lower-case hex, of what its children's hashes
make when written one after the other: its preimage.  Preimages are stored, one
row for each parent.  A leaf meets those of its ancestors by equi-joins on tree
and position; cutting its own 64 characters out of one leaves the siblings, and
putting another hash in their place and hashing anew is a step of folding.

Rows are numbered in their order by range partitions and counts of these, so a
source that holds most rows takes as many tasks as it has partitions.  Tables
of rows hold hashes only; the texts are read once.

Defined cases: null fields are hashed as ``-``; a null source is a source of its
own, the first; texts of any length are hashed whole; of rows that repeat a
doc_id the leaves are ordered by their hash, and equal ones are interchangeable;
rows without doc_id come first in their source and are never altered; an empty
table gives an empty result without a root; other columns are not read, so
their names can't clash.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import materialize

FAN = 16
#: Characters of a hash.
WIDE = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """How a field enters a leaf: ``-`` if null, else its length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(**changed: Column) -> Column:
    """The hash of a row; ``changed`` has other values for some of its fields."""
    return F.sha2(F.concat(*[field(changed.get(name, F.col(name))) for name in FIELDS]), 256)


def lower_case(text: Column) -> Column:
    """A to Z in lower case, all else as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` written in order, with the number of the range partition (_part) and that of the row in it (_at)."""
    at = F.monotonically_increasing_id()
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(rows.select("*", F.shiftright(at, 33).alias("_part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), name)


def placed(leaves: DataFrame) -> DataFrame:
    """``leaves`` (source, doc_id, leaf and any others but key, tree, pos, n) with tree, the rank of the source, pos in it, and n, its number of leaves."""
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("-"))  # null before all others
    rows = _numbered(leaves.withColumn("key", key), ["key", "doc_id", "leaf"], "ordered")
    runs = materialize(rows.groupBy("_part", "key").agg(F.count("*").alias("here"), F.min("_at").alias("first")), "runs")  # at most sources + partitions
    sources = _numbered(runs.groupBy("key").agg(F.sum("here").alias("n")), ["key"], "sources")
    ahead = sources.groupBy("_part").agg(F.count("*").alias("_n"))
    ahead = ahead.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_ahead"))  # a row for each range partition
    ranks = sources.join(ahead, "_part").select("key", "n", (F.col("_ahead") + F.col("_at")).alias("tree"))
    before = F.sum("here").over(Window.partitionBy("key").orderBy("_part")) - F.col("here")
    runs = runs.join(ranks, "key").select("_part", "key", "tree", "n", (before - F.col("first")).alias("shift"))
    return rows.join(runs, ["_part", "key"]).withColumn("pos", F.col("_at") + F.col("shift")).drop("_part", "_at", "shift", "key")


def build(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The levels above ``nodes`` (tree, pos, n, hash), from below: tree, pos, n, preimage and hash of each parent.

    A tree is at its top where n is 1; the largest one decides how many levels there are.
    """
    levels, most = [], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        children = F.transform(F.array_sort(F.collect_list(F.struct("pos", "hash"))), lambda x: x["hash"])
        up = nodes.filter("n > 1").groupBy("tree", F.expr(f"pos div {FAN}").alias("up"), "n").agg(F.array_join(children, "").alias("preimage"))
        nodes = materialize(up.select("tree", F.col("up").alias("pos"), F.ceil(F.col("n") / FAN).alias("n"), "preimage", F.sha2("preimage", 256).alias("hash")), name)
        levels.append(nodes)
        most = -(-most // FAN)
    return levels


def tops(nodes: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """The highest node of each tree: tree and hash."""
    out = nodes.filter("n = 1").select("tree", "hash")
    for level in levels:
        out = out.union(level.filter("n = 1").select("tree", "hash"))
    return out


def climb(nodes: DataFrame, levels: list[DataFrame], over: DataFrame) -> DataFrame:
    """``nodes`` with what ``over`` (tree, subroot, path) has for their trees; the preimages and slots on the way up come first in path."""
    others = [c for c in nodes.columns if c not in ("tree", "pos", "n")]
    lone = nodes.filter("n = 1").join(over, "tree").select(*others, "tree", "pos", "n", "subroot", "path")
    if not levels:
        return lone
    parents = climb(levels[0].select("tree", "pos", "n", "preimage"), levels[1:], over)
    parents = parents.select("tree", F.col("pos").alias("up"), F.col("preimage").alias("around"), "subroot", "path")
    step = F.array(F.struct(F.col("around").alias("preimage"), F.pmod("pos", F.lit(FAN)).cast("int").alias("slot")))
    below = nodes.filter("n > 1").withColumn("up", F.expr(f"pos div {FAN}")).join(parents, ["tree", "up"])
    return below.select(*others, "tree", "pos", "n", "subroot", F.concat(step, "path").alias("path")).union(lone)


def _sides(step: Column) -> tuple[Column, Column]:
    """What stands before and behind the slot of a step."""
    at = step["slot"] * WIDE
    return step["preimage"].substr(F.lit(1), at), step["preimage"].substr(at + WIDE + 1, F.lit(WIDE * FAN))


def siblings(path: Column) -> Column:
    """The siblings' hashes on the way to the root, level by level, left to right."""
    return F.array_join(F.transform(path, lambda x: F.concat(*_sides(x))), "")


def folded(hash_: Column, path: Column) -> Column:
    """The root that a leaf's hash gives along its path."""

    def step(below: Column, x: Column) -> Column:
        left, right = _sides(x)
        return F.sha2(F.concat(left, below, right), 256)

    return F.aggregate(path, hash_, step)


@dataclass
class Manifest:
    """The written tables of a dataset's tree: leaves, the levels of the sources' trees and of the tree over them; and its root."""

    leaves: DataFrame
    levels: list[DataFrame]
    subroots: DataFrame
    above: list[DataFrame]
    root: str | None

    def paths(self) -> DataFrame:
        """``leaves`` with the subroot and the path (preimage, slot), from below to the root."""
        none = F.array().cast("array<struct<preimage:string,slot:int>>")
        end = self.subroots.sparkSession.range(1).select(F.col("id").alias("tree"), F.lit(None).cast("string").alias("subroot"), none.alias("path"))
        up = climb(self.subroots, self.above, end)
        over = up.select(F.col("pos").alias("tree"), F.col("hash").alias("subroot"), "path")
        return climb(self.leaves, self.levels, over)


def manifest(docs: DataFrame, altered: Column | None = None) -> Manifest:
    """The tree of ``docs``; ``altered``: another hash of some rows, kept beside their leaf for checks (null: none)."""
    other = F.lit(None).cast("string") if altered is None else altered
    hashed = materialize(docs.select("doc_id", "source", leaf().alias("leaf"), other.alias("altered")), "leaves")
    leaves = placed(hashed)
    nodes = leaves.select("tree", "pos", "n", F.col("leaf").alias("hash"))
    levels = build(nodes, "level")
    ends = materialize(tops(nodes, levels), "subroots")
    subroots = ends.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(ends.count()).cast("long").alias("n"), "hash")
    above = build(subroots, "above")
    root = tops(subroots, above).first()  # one row, of the only tree
    return Manifest(leaves, levels, subroots, above, root["hash"] if root else None)


def verify(m: Manifest) -> DataFrame:
    """Per leaf: doc_id, source, leaf, subroot, root, siblings, folded_root (from the altered hash where there is one) and whether that is the root."""
    fold = folded(F.coalesce("altered", "leaf"), F.col("path"))
    out = m.paths().select("doc_id", "source", "leaf", "subroot", F.lit(m.root).alias("root"), siblings(F.col("path")).alias("siblings"), fold.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
