"""Near-duplicate embeddings by lattice hashing, verified by cosine.

Each table projects unit vectors to eight dimensions and decodes the result to
the nearest point of the E8 lattice; that point is the vector's cell.  A vector
also probes the neighbouring cells that it lies nearest to.  Pairs that meet in
a cell, of which one lies in it, are verified in double precision.  Equal
vectors are one node, so copies are never expanded into pairs.  Pairs that merely
share a cell go by sketches of signs before any vector moves.  A cell that many
lie in is crowded: its members are dealt into blocks whose products are taken at
once, and what leaves a block is a count of links and a root for each member,
never a row for each pair.  A pair that meets in several crowded cells counts in
the first of them, and nowhere else.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing, nor do rows without vec_id; vectors of different lengths never link; rows
that repeat a vec_id count as other vectors; an empty table gives an empty
result; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .session import join_even, materialize, small_batches
from .vectext import U64, mix

COSINE = 0.95
#: Tables, neighbouring cells probed in each, and the side of the lattice in 64 dimensions.
TABLES, PROBES, SIDE = 14, 6, 0.12
#: Vectors that lie in a cell before it is crowded, and members of a block of a crowded one.
CROWD, BLOCK = 16, 2048
#: Signs of a vector's sketch, and how many may differ between two that are verified: at the
#: threshold a tenth do, and more than these with probability 1e-8.
SIGNS, DIFFERENT = 128, 36


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(axis=1).astype(np.int64) & 1)
    if len(odd):
        off = x[odd] - r[odd]
        k = np.abs(off).argmax(axis=1)
        r[odd, k] += np.where(off[np.arange(len(odd)), k] >= 0, 1.0, -1.0)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, doubled so that they are whole numbers."""
    a, b = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    near_a = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.rint(2 * np.where(near_a[:, None], a, b)).astype(np.int64)


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled."""
    out = []
    for i in range(8):
        for j in range(i):
            for s in (2, -2):
                for t in (2, -2):
                    v = np.zeros(8, np.int64)
                    v[i], v[j] = s, t
                    out.append(v)
    for m in range(256):
        v = np.array([1 if m >> k & 1 else -1 for k in range(8)])
        if (v < 0).sum() % 2 == 0:
            out.append(v)
    return np.array(out)


def side(dim: int) -> float:
    """The lattice's side: eight of ``dim`` directions hold 8 / dim of a squared distance."""
    return SIDE * (64 / dim) ** 0.5


def projections(dim: int, tables: int = TABLES, seed: int = 8) -> np.ndarray:
    """For each table eight orthonormal directions, scaled to the side."""
    rng = np.random.default_rng(seed)
    out = np.empty((tables, dim, 8))
    for t in range(tables):
        g = rng.standard_normal((dim, max(8, 8)))
        out[t] = np.linalg.qr(g)[0][:, :8] if dim >= 8 else g / np.sqrt(8)
    return out / side(dim)


def cells(x: np.ndarray, tables: int = TABLES, probes: int = PROBES) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the own cell, and of the probed ones, of unit vectors in each table."""
    place = np.random.default_rng(88).integers(1, 2**64, 8, dtype=np.uint64) | U64(1)
    own, more = np.empty((len(x), tables), U64), np.empty((len(x), tables, probes), U64)
    short = minimal_vectors()
    for t, p in enumerate(projections(x.shape[1], tables)):
        y = x @ p
        at = nearest_e8(y)
        # The distance to a neighbour grows with -<offset, neighbour>, all neighbours being as long.
        gain = (y - at / 2) @ short.T
        best = np.argpartition(-gain, probes - 1, axis=1)[:, :probes] if probes else np.zeros((len(x), 0), np.int64)
        name = lambda z: mix((z.astype(U64) * place).sum(axis=-1, dtype=U64) + U64((t + 1) * 0x9E3779B97F4A7C15 % 2**64))
        own[:, t] = name(at)
        more[:, t] = name(at[:, None, :] + short[best])
    return own, more


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, the vector as doubles, and whether the row can link."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    able = F.col("vec_id").isNotNull() & fine & F.exists("vector", lambda x: x != 0)
    return v.withColumn("good", F.coalesce(able, F.lit(False)))


def sketches(x: np.ndarray) -> np.ndarray:
    """Signs of random projections, as two 64-bit numbers for each vector."""
    signs = x @ np.random.default_rng(64).standard_normal((x.shape[1], SIGNS)) > 0
    return np.packbits(signs, axis=1).view(np.int64)


def _keyed(nodes: DataFrame) -> DataFrame:
    """(bucket, node, own, sketch1, sketch2): own cells and probed ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, raw = batch.column("node").to_numpy(), batch.column("vector").to_pylist()
            size = np.fromiter(map(len, raw), np.int64, len(raw))
            for dim in np.unique(size):
                which = np.flatnonzero(size == dim)
                x = np.array([raw[i] for i in which])
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                own, more = cells(x)
                sketch = sketches(x)
                for key, flag in ((own, True), (more.reshape(len(x), -1), False)):
                    yield pa.RecordBatch.from_arrays([pa.array((key + U64(int(dim))).view(np.int64).ravel()), pa.array(np.repeat(node[which], key.shape[1])), pa.array(np.full(key.size, flag))] + [pa.array(np.repeat(sketch[:, k], key.shape[1])) for k in (0, 1)], names=["bucket", "node", "own", "sketch1", "sketch2"])

    return nodes.select("node", "vector").mapInArrow(run, "bucket long, node long, own boolean, sketch1 long, sketch2 long")


def meetings(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (bucket, node, own) of cells where pairs may meet: those of the others, and those of crowded cells with ``many``, their number."""
    keyed = materialize(_keyed(nodes), "cells")
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("many"), F.count_if("own").alias("owners")).filter("many > 1 and owners > 0")
    live = materialize(join_even(keyed, sizes, ["bucket"]), "cells")
    return live.filter(f"owners <= {CROWD}").select("bucket", "node", "own", "sketch1", "sketch2"), live.filter(f"owners > {CROWD}").select("bucket", "node", "own", "many")


def candidates(rows: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a < b, one of which lies in a cell that the other lies in or probes; ``rows`` has no crowded cells.

    A cell with one node, or with probes alone, gives no pair; neither do rows
    that repeat; without rows there are none.
    """
    marks = [F.col(f"sketch{k}") for k in (1, 2)]
    own = rows.filter("own").select("bucket", F.col("node").alias("p"), *[m.alias(f"p{k}") for k, m in enumerate(marks)])
    others = rows.select("bucket", F.col("node").alias("q"), "own", *[m.alias(f"q{k}") for k, m in enumerate(marks)])
    apart = sum((F.bit_count(F.col(f"p{k}").bitwiseXOR(F.col(f"q{k}"))) for k in range(2)), F.lit(0))
    met = join_even(own, others, ["bucket"]).filter(F.expr("(own and p < q) or (not own and p <> q)") & (apart <= DIFFERENT))
    return met.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def _unit(x: np.ndarray) -> np.ndarray:
    """Vectors at unit length, scaled by the largest component before, lest squares overflow or vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def verified(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose cosine is at least COSINE and that meet in no crowded cell, with it; nodes are (node, vector, inside, near)."""
    side = lambda k: nodes.select(F.col("node").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("vector", "inside", "near")])
    crowd = F.arrays_overlap("inside_a", "near_b") | F.arrays_overlap("near_a", "inside_b")
    both = join_even(join_even(pairs, side("a"), ["a"]), side("b"), ["b"]).filter((F.size("vector_a") == F.size("vector_b")) & ~F.coalesce(crowd, F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.diff(batch.column("vector_a").offsets.to_numpy())
            for dim in np.unique(size):
                which = pa.array(np.flatnonzero(size == dim))
                x, y = (_unit(batch.column(c).take(which).flatten().to_numpy().reshape(-1, dim)) for c in ("vector_a", "vector_b"))
                c = (x * y).sum(axis=1)
                good = pa.array(c >= COSINE)
                yield pa.RecordBatch.from_arrays([batch.column(k).take(which).filter(good) for k in ("a", "b")] + [pa.array(c).filter(good)], names=["a", "b", "cosine"])

    return both.select("a", "b", "vector_a", "vector_b").mapInArrow(run, "a long, b long, cosine double")


class _Members:
    """Members of one block of a crowded cell that have vectors of one length."""

    def __init__(self, table: pa.Table) -> None:
        self.node, self.copies, self.own = (table.column(c).to_numpy() for c in ("node", "copies", "own"))
        self.x = _unit(table.column("vector").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1))
        self.keys = {}
        for c in ("inside", "near"):
            lists = table.column(c).combine_chunks()
            self.keys[c] = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())

    def incidence(self, name: str, known: np.ndarray) -> np.ndarray:
        """Which members have which of the sorted keys."""
        keys, size = self.keys[name]
        out = np.zeros((len(self.node), len(known)), np.float32)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        hit = known[at] == keys
        out[np.repeat(np.arange(len(size)), size)[hit], at[hit]] = 1
        return out


def _linked_block(bucket: int, a: _Members, b: _Members, same: bool) -> np.ndarray:
    """Which members of two blocks (or of one) are linked and meet in no crowded cell before this one."""
    good = (a.x @ b.x.T >= COSINE) & (a.own[:, None] | b.own[None, :])
    if same:
        good = np.triu(good, 1)
    known = np.unique(np.concatenate([m.keys["near"][0] for m in (a, b)]))
    known = known[known < bucket]
    for k in range(0, len(known) if good.any() else 0, 4096):
        some = known[k : k + 4096]
        met = a.incidence("inside", some) @ b.incidence("near", some).T + a.incidence("near", some) @ b.incidence("inside", some).T
        good &= met == 0
    return good


def _roots(good: np.ndarray) -> np.ndarray:
    """For each node of a symmetric link matrix the smallest one that it reaches."""
    label = np.arange(len(good))
    while True:
        low = np.minimum(label, np.where(good, label[None, :], len(good)).min(axis=1))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def crowded(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, others, root) from the cells of ``rows`` (bucket, node, own, many): vectors linked to a node, copies counted, and a node that it reaches."""
    blocks = F.ceil(F.col("many") / BLOCK).cast("int")
    dealt = rows.withColumn("_g", blocks).withColumn("part", F.pmod(F.xxhash64("node"), F.col("_g")).cast("int"))
    dealt = join_even(dealt, nodes.select("node", "copies", "vector", "inside", "near"), ["node"]).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
    dealt = dealt.withColumn("x", F.least("part", "_o")).withColumn("y", F.greatest("part", "_o")).drop("_o", "_g", "many")

    def run(table: pa.Table) -> pa.Table:
        bucket, x, y = (table.column(c)[0].as_py() for c in ("bucket", "x", "y"))
        size, part = np.array([len(v) for v in table.column("vector")]), table.column("part").to_numpy()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for dim in np.unique(size):
            here = [(size == dim) & (part == k) for k in (x, y)]
            if not (here[0].any() and here[1].any()):
                continue
            a, b = (_Members(table.filter(pa.array(h))) for h in here)
            good = _linked_block(bucket, a, b, x == y)
            if not good.any():
                continue
            if x == y:
                node, whole = a.node, good | good.T
                others = whole @ a.copies
            else:
                node, n = np.concatenate((a.node, b.node)), len(a.node)
                whole = np.zeros((len(node), len(node)), bool)
                whole[:n, n:], whole[n:, :n] = good, good.T
                others = np.concatenate((good @ b.copies, good.T @ a.copies))
            hit = np.flatnonzero(others)
            out.append((node[hit], others[hit], node[_roots(whole)[hit]]))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("node", "others", "root"), cols)})

    return dealt.groupBy("bucket", "x", "y").applyInArrow(run, "node long, others long, root long")


def linked(vectors: DataFrame) -> DataFrame:
    """Per row of ``vectors``: vec_id, n_links and component_id."""
    small_batches(vectors.sparkSession)
    rows = usable(vectors).withColumn("key", F.when(F.col("good"), F.sha2(F.to_json("vector"), 256)))
    rows = materialize(rows.select("vec_id", "key", F.when(F.col("good"), F.col("vector")).alias("vector")), "vectors")
    nodes = rows.filter("key is not null").groupBy("key").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    few, many = meetings(nodes)
    lists = many.groupBy("node").agg(F.collect_list(F.when(F.col("own"), F.col("bucket"))).alias("inside"), F.collect_list("bucket").alias("near"))  # one for each table and probe
    full = materialize(join_even(nodes.drop("key", "low"), lists, ["node"], "left"), "payload")
    links = materialize(verified(candidates(few), full).select("a", "b"), "links")
    counted = materialize(crowded(many, full), "crowds")
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a"))
    ends = join_even(ends, nodes.select(F.col("node").alias("other"), "copies"), ["other"]).select("node", F.col("copies").alias("others"))
    others = ends.union(counted.select("node", "others")).groupBy("node").agg(F.sum("others").alias("others"))
    joined = components(links.union(counted.filter("node <> root").select("node", "root")).toDF("a", "b"))
    known = materialize(join_even(join_even(nodes.drop("vector"), others, ["node"], "left"), joined, ["node"], "left").withColumn("component", F.coalesce("component", "node")), "known")
    lowest = known.groupBy("component").agg(F.min("low").alias("component_id"))
    known = materialize(join_even(known, lowest, ["component"]).select("key", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id"), "classes")
    out = join_even(rows.select("vec_id", "key"), known, ["key"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))


__all__ = ["candidates", "cells", "crowded", "linked", "meetings", "usable", "verified"]
