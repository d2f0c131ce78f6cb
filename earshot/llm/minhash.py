"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

Every permutation gives two signature values, its minimum and its maximum over
a document's shingle hashes, so half the hash evaluations are enough; values
are banded in fours.  Documents with equal sets are one node.  Texts move once:
those of nodes that share a bucket become a table that all later steps read.
Nodes with too many shingles of their own to link at all are set aside.  In
each bucket all members are compared with one hub, the member whose buckets are
largest, since that is the text most of a family derives from.  What the hubs
leave apart is compared by classes: shingles that exactly the same nodes have
are one class with a weight, and sets become short lists of classes.  Prefix
filtering, rarest classes first, brings lists together; their overlaps are
products of blocks, and a block leaves a forest of its links, so a family of
loose copies gives no rows for its pairs.  Each link is confirmed on whole sets
by 128-bit digests of its shingles.

Defined cases: texts with fewer words than a shingle have one shingle, the
whole sequence; null texts, and texts without words, have none, link with
nothing and stay; texts of any length count whole; rows that repeat a doc_id
are nodes by their sets, and share a fate only where their texts are equal; a
row without doc_id links with nothing and stays; an empty table gives an empty
result; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import binaries
from .graph import components
from .session import discard, documents, join_even, materialize, packed, small_batches
from .vectext import U64, Words, blocks, mix

SHINGLE = 5
#: Least similarity of linked documents where the caller names none.
PERCENT = 85
PERMUTATIONS, ROWS = 48, 4
#: Members that are compared with a hub in one task, and their shingles, of 16 bytes each.
TASK_MEMBERS, TASK_SHINGLES = 256, 1 << 20
#: Nodes of a block that is multiplied with another one, and classes at a time.
BLOCK, CLASSES = 512, 4096

_rng = np.random.default_rng(5)
_MULTIPLY = _rng.integers(1, 2**64, PERMUTATIONS, dtype=np.uint64) | U64(1)
_ADD = _rng.integers(0, 2**64, PERMUTATIONS, dtype=np.uint64)
_PLACE = _rng.integers(1, 2**64, 64, dtype=np.uint64) | U64(1)


def shingle_sets(block: list[bytes], width: int = SHINGLE, checks: bool = False) -> tuple[np.ndarray, ...]:
    """Sorted distinct shingle hashes of each text in turn, and where each text's begin; ``checks``: also other hashes of the same shingles."""
    words = Words(block, lower=True)
    n = np.diff(words.first)

    def hashes(seed: int) -> tuple[np.ndarray, np.ndarray]:
        h = words.hashes(seed)
        at = np.zeros(max(len(h) - width + 1, 0), U64)
        for k in range(width if len(at) else 0):
            at = mix(at + h[k : len(h) - width + 1 + k] + _PLACE[k])
        return h, at

    def short(h: np.ndarray) -> np.ndarray:
        out = np.zeros(1, U64)
        for k in range(len(h)):
            out = mix(out + h[k] + _PLACE[width + k])
        return out

    both = [hashes(seed) for seed in range(1 + checks)]
    sets, more, upto = [], [], np.zeros(len(block) + 1, np.int64)
    for i, (first, many) in enumerate(zip(words.first.tolist(), n.tolist())):
        if many >= width:
            here = slice(first, first + many - width + 1)
            one, where = np.unique(both[0][1][here], return_index=True) if checks else (np.unique(both[0][1][here]), None)
            other = both[1][1][here][where] if checks else None
        elif many:
            one, *rest = (short(h[first : first + many]) for h, _ in both)
            other = rest[0] if rest else None
        else:
            one = other = both[0][1][:0]
        sets.append(one)
        more.append(other)
        upto[i + 1] = upto[i] + len(one)
    return (np.concatenate(sets), upto, np.concatenate(more)) if checks else (np.concatenate(sets), upto)


def signatures(values: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """Minimum and maximum under each permutation, in turn, of each non-empty set."""
    begin = upto[:-1]
    out = np.empty((len(begin), 2 * PERMUTATIONS), U64)
    for k in range(PERMUTATIONS):
        v = values * _MULTIPLY[k] + _ADD[k]
        out[:, 2 * k] = np.minimum.reduceat(v, begin)
        out[:, 2 * k + 1] = np.maximum.reduceat(v, begin)
    return out


SIGNED = "doc_id long, text string, n_shingles long, set1 long, set2 long, bands binary"


def signed(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, text, n_shingles, a 128-bit digest of the set, and a 64-bit hash for each band."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for block in blocks(t.encode() for t in batch.column("text").to_pylist()):
                values, upto = shingle_sets(block)
                n = np.diff(upto)
                full = np.flatnonzero(n)
                bands = 2 * PERMUTATIONS // ROWS
                sig = np.zeros((len(block), bands), U64)
                key = np.zeros((2, len(block)), U64)
                if len(full):
                    begin = upto[:-1][full]
                    parts = signatures(values, np.append(begin, len(values))).reshape(len(full), bands, ROWS)
                    sig[full] = mix((parts * _PLACE[:ROWS]).sum(axis=2, dtype=U64) + np.arange(bands, dtype=U64))
                    for k in range(2):
                        key[k, full] = mix(np.add.reduceat(mix(values + U64(11 + k)), begin) + n[full].astype(U64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(at, len(block)) for c in ("doc_id", "text")] + [pa.array(n), pa.array(key[0].view(np.int64)), pa.array(key[1].view(np.int64)), binaries(sig.view(np.uint8).ravel(), np.arange(len(block) + 1) * 8 * bands)],
                    names=["doc_id", "text", "n_shingles", "set1", "set2", "bands"],
                )
                at += len(block)

    return documents(docs).mapInArrow(run, SIGNED)


def _buckets(nodes: DataFrame) -> DataFrame:
    """Per node and band: node, n and the bucket's key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = 2 * PERMUTATIONS // ROWS
            keys = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(c).to_numpy(), b)) for c in ("node", "n")] + [pa.array(keys)], names=["node", "n", "bucket"])

    return nodes.select("node", "n", "bands").mapInArrow(run, "node long, n long, bucket long")


def _blocks(batch: pa.RecordBatch, **options: bool) -> Iterator[tuple[int, int, tuple[np.ndarray, ...]]]:
    """Shingle sets of the texts of a batch: the number of the first text, how many, and what ``shingle_sets`` gives."""
    at = 0
    for block in blocks(t.encode() for t in batch.column("text").to_pylist()):
        yield at, len(block), shingle_sets(block, **options)
        at += len(block)


def _confirm(texts: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those pairs (hub, member, n: the member's size) of nodes whose sets are near enough, as (a, b); ``texts`` has node and text.

    A hub's members are dealt out over groups that are bounded in number and in
    shingles, each of which gets the hub's set too.
    """
    sizes = pairs.groupBy("hub").agg(F.greatest(F.ceil(F.count("*") / TASK_MEMBERS), F.ceil(F.sum("n") / TASK_SHINGLES)).alias("groups"))
    dealt = join_even(pairs, sizes, ["hub"])
    dealt = materialize(dealt.select("hub", "member", F.pmod(F.xxhash64("member"), "groups").alias("group")), "dealt")
    wanted = dealt.select(F.col("member").alias("node"), "hub", "group").union(dealt.select(F.col("hub").alias("node"), "hub", "group").distinct())

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, many, (values, upto, checks) in _blocks(batch, checks=True):
                both = [binaries(v.view(np.uint8), 8 * upto) for v in (values, checks)]
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(at, many) for c in ("node", "hub", "group")] + both, names=["node", "hub", "group", "shingles", "checks"])

    def compare(table: pa.Table) -> pa.Table:
        hub, nodes = table.column("hub")[0].as_py(), table.column("node").to_pylist()
        get = lambda i: (np.frombuffer(table.column(c)[i].as_py(), U64) for c in ("shingles", "checks"))
        own, own_check = get(nodes.index(hub))
        good = []
        for i, d in enumerate(nodes):
            if d != hub:
                other, check = get(i)
                at = np.minimum(np.searchsorted(own, other), len(own) - 1)
                both = int(((own[at] == other) & (own_check[at] == check)).sum())
                if 100 * both >= percent * (len(own) + len(other) - both):
                    good.append(d)
        return pa.table({"a": pa.array([hub] * len(good), pa.int64()), "b": pa.array(good, pa.int64())})

    found = join_even(texts, wanted, ["node"]).select("node", "hub", "group", "text").mapInArrow(sets, "node long, hub long, group long, shingles binary, checks binary")
    out = materialize(found.groupBy("hub", "group").applyInArrow(compare, "a long, b long"), "confirmed")
    discard(dealt)
    return out


def _shingle_rows(texts: DataFrame, *more: str) -> DataFrame:
    """(node, shingle) of the texts (node, text), and those columns of them that ``more`` names, which are long."""
    names = ["node", *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, many, (values, upto) in _blocks(batch):
                own = [np.repeat(batch.column(c).slice(at, many).to_numpy(), np.diff(upto)) for c in names]
                for k in range(0, len(values), 1 << 16):
                    part = slice(k, k + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(x[part]) for x in (*own, values.view(np.int64))], names=[*names, "shingle"])

    return texts.select(*names, "text").mapInArrow(run, "".join(f"{c} long, " for c in names) + "shingle long")


def _worth_it(texts: DataFrame, percent: int) -> DataFrame:
    """Those of the nodes (node, n, text) that may link at all.

    Shingles that no other of these nodes has can't be in an intersection.  A
    node that has too many of them is below the threshold with every other one,
    so it needs no comparison.
    """
    lone = _shingle_rows(texts).groupBy("shingle").agg(F.count("*").alias("c"), F.min("node").alias("node")).filter("c = 1").groupBy("node").agg(F.count("*").alias("lone"))
    left = F.col("n") - F.coalesce("lone", F.lit(0))
    return texts.select("node", "n").join(lone.hint("merge"), "node", "left").filter(left * 100 >= F.col("n") * percent).select("node")


def _classed(texts: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Per node of ``nodes`` (node, n, component) that may link with one of another component: its prefix and its whole list of classes.

    A class is all shingles that exactly the same nodes have; it is named by
    their number and 128 bits of their hashes.  Shingles of one component alone
    are in no intersection that matters.
    """
    each = materialize(_shingle_rows(texts.join(nodes.select("node", "component").hint("merge"), "node"), "component"), "shingles")
    names = [F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"x{k}") for k in (1, 2)]
    kinds = each.groupBy("shingle").agg(F.count("*").alias("many"), F.min("component").alias("low"), F.max("component").alias("high"), *names).filter("low <> high")
    kinds = kinds.select("shingle", "many", F.xxhash64("many", "x1", "x2").alias("class"))
    weights = join_even(each.drop("component"), kinds, ["shingle"]).groupBy("node", "many", "class").agg(F.count("*").alias("weight"))
    lists = weights.groupBy("node").agg(F.sum("weight").alias("whole"), F.array_sort(F.collect_list(F.struct("many", "class", "weight"))).alias("list"))  # a node's own shingles at most
    rows = nodes.join(lists.hint("merge"), "node").filter(F.col("whole") * 100 >= F.col("n") * percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, weights = batch.column("classes"), batch.column("weights")
            prefix = []
            for i, (n, whole) in enumerate(zip(batch.column("n").to_pylist(), batch.column("whole").to_pylist())):
                # Another set near enough shares at least n * percent / 100 shingles, so one of the first classes.
                left = whole - np.concatenate(([0], np.cumsum(weights[i].values.to_numpy())[:-1]))
                prefix.append(classes[i].values.to_numpy()[100 * left >= n * percent])
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("node", "n", "component")] + [pa.array(prefix, pa.list_(pa.int64())), classes, weights], names=["node", "n", "component", "prefix", "classes", "weights"])

    rows = rows.select("node", "n", "component", "whole", F.col("list.class").alias("classes"), F.col("list.weight").cast("array<int>").alias("weights"))
    out = materialize(rows.mapInArrow(run, "node long, n long, component long, prefix array<long>, classes array<long>, weights array<int>"), "classes")
    discard(each)
    return out


def forest(good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a symmetric link matrix that keep its components: nodes and the neighbour that each hangs on."""
    seen = ~good.any(axis=1)
    nodes, parents = [], []
    for k in range(len(good)):
        if seen[k]:
            continue
        seen[k], edge = True, np.array([k])
        while len(edge):
            new = np.flatnonzero(good[edge].any(axis=0) & ~seen)
            seen[new] = True
            nodes.append(new)
            parents.append(edge[good[np.ix_(edge, new)].argmax(axis=0)] if len(new) else new)
            edge = new
    return (np.concatenate(nodes), np.concatenate(parents)) if nodes else (np.zeros(0, np.int64),) * 2


def _rest_pairs(texts: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (hub, member, n) of nodes (node, n, component) in different components, so that links between them reach as far as all of theirs do.

    Of the nodes that share a prefix class, those outside the largest component
    (left) are compared with all others (right), so members of one component
    never meet.  Both are dealt into blocks, and each left block meets each right one.
    """
    lists = _classed(texts, nodes, percent)
    prefix = lists.select("node", "component", F.explode("prefix").alias("class"))
    per = prefix.groupBy("class", "component").agg(F.count("*").alias("c"))
    per = per.groupBy("class").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.sum("c").alias("rights"), F.max("c").alias("most"), F.count("*").alias("several")).filter("several > 1")
    blocks_ = lambda c: F.ceil(c / BLOCK).cast("int")
    per = per.select("class", "main", blocks_(F.col("rights")).alias("nr"), blocks_(F.col("rights") - F.col("most")).alias("nl"))
    met = join_even(prefix, per, ["class"])

    at = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    spread = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    is_left = F.col("component") != F.col("main")
    # A node that is on both sides of a task comes once.
    right = met.select("class", "node", is_left.alias("_left"), at("nl").alias("_l"), spread("nl").alias("l"), at("nr").alias("r"))
    right = right.select("class", "node", "l", "r", (F.col("_left") & (F.col("l") == F.col("_l"))).alias("left"), F.lit(True).alias("right"))
    left = met.filter(is_left).select("class", "node", at("nl").alias("l"), at("nr").alias("_r"), spread("nr").alias("r")).filter("r <> _r")
    left = left.select("class", "node", "l", "r", F.lit(True).alias("left"), F.lit(False).alias("right"))
    placed = join_even(right.union(left), lists.drop("prefix").withColumnRenamed("classes", "list"), ["node"])

    def compare(table: pa.Table) -> pa.Table:
        sides = [table.column(c).to_numpy(zero_copy_only=False) for c in ("left", "right")]
        node, n, component = (table.column(c).to_numpy() for c in ("node", "n", "component"))
        lists_, weights = (table.column(c).combine_chunks() for c in ("list", "weights"))
        keys, weight, size = lists_.flatten().to_numpy(), weights.flatten().to_numpy(), np.diff(lists_.offsets.to_numpy())
        owner = np.repeat(np.arange(len(node)), size)
        a, b = (np.flatnonzero(side) for side in sides)
        place = [np.cumsum(side) - 1 for side in sides]
        known, at = np.unique(keys, return_inverse=True)
        has = [np.bincount(at[side[owner]], minlength=len(known)) > 0 for side in sides]
        column = np.where(has[0] & has[1], np.cumsum(has[0] & has[1]) - 1, -1)[at]  # classes that both sides have
        both = np.zeros((len(a), len(b)))
        for k in range(0, int(column.max(initial=-1)) + 1, CLASSES):
            some = (column >= k) & (column < k + CLASSES)
            x, y = np.zeros((len(a), CLASSES), np.float32), np.zeros((len(b), CLASSES), np.float32)
            for matrix, side, where, value in ((x, sides[0], place[0], weight), (y, sides[1], place[1], np.ones(len(keys)))):
                w = np.flatnonzero(some & side[owner])
                matrix[where[owner[w]], column[w] - k] = value[w]
            both += x @ y.T
        good = 100 * both >= percent * (n[a][:, None] + n[b][None, :] - both)
        good &= component[a][:, None] != component[b][None, :]
        name, first, where = np.unique(node, return_index=True, return_inverse=True)  # a node may be on both sides
        square = np.zeros((len(name), len(name)), bool)
        square[np.ix_(where[a], where[b])] = good
        one, other = forest(square | square.T)
        return pa.table({"hub": pa.array(name[other], pa.int64()), "member": pa.array(name[one], pa.int64()), "n": pa.array(n[first[one]], pa.int64())})

    out = materialize(placed.groupBy("class", "l", "r").applyInArrow(compare, "hub long, member long, n long").distinct(), "rest")
    discard(lists)
    return out


def near(n: str, m: str, percent: int) -> F.Column:
    """Sizes that the threshold allows."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def links(rows: DataFrame, nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Confirmed links (a, b) between nodes (node, row, n, bands) so that components are those of all links; ``rows`` has row and text."""
    buckets = materialize(_buckets(nodes), "buckets")
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("many")).filter("many > 1")
    shared = materialize(join_even(buckets, sizes, ["bucket"]).select("bucket", "node", "n"), "buckets")
    wanted = nodes.select("node", "row", "n").join(shared.select("node").distinct().hint("merge"), "node")
    texts = materialize(join_even(rows.select("row", "text"), wanted, ["row"]).select("node", "n", "text"), "texts")
    # A node has a row for each band at most, so joins by nodes have no hot key.
    shared_ = materialize(shared.join(_worth_it(texts, percent).hint("merge"), "node"), "buckets")
    sizes = shared_.groupBy("bucket").agg(F.count("*").alias("many")).filter("many > 1")
    live = materialize(join_even(shared_, sizes, ["bucket"]), "live")
    discard(buckets, shared, shared_)
    weight = live.groupBy("node").agg(F.sum("many").alias("weight"))
    hubs = live.join(weight.hint("merge"), "node").groupBy("bucket").agg(F.max_by(F.struct("node", "n"), F.struct("weight", -F.col("node"))).alias("hub"))
    pairs = join_even(live, hubs, ["bucket"]).filter("node <> hub.node").select(F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("node").alias("member"), "n")
    pairs = pairs.filter(near("n", "hub_n", percent)).select("hub", "member", "n").distinct()
    pairs = materialize(pairs, "pairs")
    known = _confirm(texts, pairs, percent)
    discard(pairs)
    # What lies in one bucket but in several components is compared further.
    merged = components(known)
    joined = materialize(live.join(merged.hint("merge"), "node", "left").select("bucket", "node", "n", F.coalesce("component", "node").alias("component")), "joined")
    mixed = joined.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("bucket")
    left = materialize(join_even(joined, mixed, ["bucket"]).select("node", "n", "component").distinct(), "left")
    discard(live, joined)
    rest = _rest_pairs(texts, left, percent)
    more = _confirm(texts, rest, percent)
    discard(rest, left, texts)
    return known.union(more)


def groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles and component_id, the smallest doc_id reachable by links of that similarity or more."""
    return _grouped(docs, percent).select("doc_id", "n_shingles", "component_id")


def _grouped(docs: DataFrame, percent: int) -> DataFrame:
    """``groups`` with a digest of each row's text."""
    rows = materialize(signed(docs).withColumn("row", F.monotonically_increasing_id()), "signed")
    able = rows.filter("n_shingles > 0 and doc_id is not null")
    nodes = able.groupBy("set1", "set2").agg(F.min("doc_id").alias("low"), F.min("row").alias("row"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    merged = components(links(rows, nodes, percent))
    known = materialize(nodes.select("set1", "set2", "node", "low").join(merged.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node")), "known")
    lowest = known.groupBy("component").agg(F.min("low").alias("component_id"))
    classes = join_even(known, lowest, ["component"]).select("set1", "set2", "component_id")
    digest = F.xxhash64("text").alias("digest")
    out = join_even(rows.select("doc_id", "n_shingles", "set1", "set2", digest), classes, ["set1", "set2"], "left")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return out.select("doc_id", "digest", "n_shingles", F.when(linked, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def deduplicate(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each group, with their columns; a row is known by its doc_id and a 64-bit hash of its text."""
    gone = _grouped(docs, percent).filter("doc_id <> component_id").select(F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest"))
    gone = materialize(gone.distinct(), "gone")
    digest = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    keyed = packed(docs, _doc=F.col("doc_id"), _digest=digest)
    return keyed.join(gone, ["_doc", "_digest"], "left_anti").select("_row.*")
