"""Removal of long byte strings that an earlier document has too, by suffix arrays.

A string of ``LENGTH`` bytes has one anchor: the leftmost smallest hash among
its substrings of ``ANCHOR`` bytes.  Equal strings have equal anchors, so only
the neighbourhoods (regions) of anchors that several documents share can hold
repeats; all else is dropped before any text moves.  Regions are dealt into
shards by their anchor; each shard sorts its suffixes by Larsson-Sadakane
refinement, finds common prefixes by Kasai's method, and so the smallest doc_id
that has each string.  An anchor in very many documents is dealt over several
shards, whose sorted strings are then merged by binary search.

Defined cases: null and empty texts have nothing to remove; a text that equals
an earlier one is removed whole if it is long enough; texts of any length are
read whole; rows that repeat a doc_id are one document and don't remove each
other; rows without doc_id come after all others, as one document with any of the
largest possible doc_id; an empty table
gives an empty result; other columns are not read, so
their names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import discard, documents, materialize, small_batches
from .vectext import U64, blocks, prefix_hash, ragged, span_hash

LENGTH, ANCHOR = 50, 20
#: Bytes of text in a pack, and for each bucket of anchors or shard of regions.
PACK, BUCKET = 4 << 20, 4 << 20
#: Bytes of text from which on packs grow, and the largest pack.
PACKS, MOST = 1 << 30, 16 << 20
#: Documents that share an anchor before its regions are dealt over all shards;
#: the regions of that many documents fill a shard by themselves.
HOT = BUCKET // (2 * LENGTH - ANCHOR)
#: Orders rows without doc_id: they come after all others, as one document (with any of this doc_id).
NO_ID = (1 << 63) - 1
_WINDOW = LENGTH - ANCHOR + 1
_SLICE = 1 << 22
_LOW = U64((1 << 24) - 1)


# -- suffix arrays -----------------------------------------------------------


def suffix_order(data: np.ndarray) -> np.ndarray:
    """All suffixes in order: by eight bytes, doubled on groups that are not sorted yet until none is left."""
    n = len(data)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    key = np.zeros(n, U64)
    for k in range(8):
        key |= padded[k : k + n].astype(U64) << U64(56 - 8 * k)
    order = np.argsort(key, kind="stable")
    new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    h = 8
    while h < n:
        edge = np.append(np.flatnonzero(new), n)
        alone = np.diff(edge) == 1
        at = ragged(edge[:-1][~alone], np.diff(edge)[~alone])  # places in groups of several
        if not len(at):
            break
        who = order[at]
        after = np.where(who + h < n, rank[np.minimum(who + h, n - 1)] + 1, 0)
        both = rank[who] * (n + 1) + after
        turn = np.argsort(both, kind="stable")
        order[at] = who[turn]
        both = both[turn]
        fresh = np.concatenate(([True], both[1:] != both[:-1]))
        new[at] = fresh
        rank[order[at]] = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        h *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, begin: np.ndarray, end: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Bytes, ``most`` at most, that each suffix shares with the one before it in the order.

    Kasai's method: the suffix one further on shares at most one byte less.  It
    runs through all regions data[begin:end], which cover the data, in step.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, np.int64)
    have = np.zeros(len(begin), np.int64)
    for t in range(int((end - begin).max(initial=0))):
        all_ = np.flatnonzero(begin + t < end)
        i = begin[all_] + t
        have[all_] = np.where(before[i] < 0, 0, np.maximum(have[all_] - 1, 0))
        live = all_[before[i] >= 0]
        while len(live):
            i = begin[live] + t
            j, k = before[i], have[live]
            ok = (k < most) & (np.maximum(i, j) + k < n)
            ok[ok] = data[i[ok] + k[ok]] == data[j[ok] + k[ok]]
            live = live[ok]
            have[live] += 1
        out[begin[all_] + t] = have[all_]
    return out


def smallest_owner(data: np.ndarray, begin: np.ndarray, end: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each byte that begins a string of LENGTH in its region, the smallest doc that has the string in any of them."""
    order = suffix_order(data)
    shared = common_prefixes(data, order, begin, end)
    whole = np.arange(len(data)) + LENGTH <= np.repeat(end, end - begin)
    owner = np.where(whole, np.repeat(doc, end - begin), np.iinfo(np.int64).max)[order]
    first = np.flatnonzero(shared[order] < LENGTH)
    low = np.minimum.reduceat(owner, first)
    out = np.empty(len(data), np.int64)
    out[order] = np.repeat(low, np.diff(np.append(first, len(order))))
    return out


# -- anchors -----------------------------------------------------------------


class Anchors:
    """Anchors of a block of documents and the runs of strings that have them."""

    def __init__(self, block: list[bytes]) -> None:
        raw = b"\0".join(block) + b"\0"
        self.data = np.frombuffer(raw, np.uint8)
        size = np.fromiter(map(len, block), np.int64, len(block))
        self.begin = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
        self.end = self.begin + size
        self.prefix = prefix_hash(self.data)
        n = len(self.data)
        if n < LENGTH:
            self.low = self.high = self.doc = np.zeros(0, np.int64)
            self.mark = np.zeros(0, U64)
            return
        starts = np.arange(n - ANCHOR + 1)
        h = span_hash(self.prefix, starts, starts + ANCHOR)
        anchor = np.empty(n - LENGTH + 1, np.int64)
        for a in range(0, len(anchor), _SLICE):  # the low bits hold the place within a slice
            b = min(len(anchor), a + _SLICE)
            v = (h[a : b + _WINDOW - 1] & ~_LOW) | np.arange(b - a + _WINDOW - 1, dtype=U64)
            for k in (1, 2, 4, 8):
                v = np.minimum(v[:-k], v[k:])
            v = np.minimum(v[: b - a], v[_WINDOW - 16 : _WINDOW - 16 + b - a])
            anchor[a:b] = a + (v & _LOW).astype(np.int64)
        many = np.maximum(size - LENGTH + 1, 0)
        place = ragged(self.begin, many)  # where strings begin
        owner = np.repeat(np.arange(len(block)), many)
        at = anchor[place]
        new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])))) if len(at) else np.zeros(0, np.int64)
        self.low, self.doc = place[new], owner[new]  # first string of each run
        self.high = place[np.append(new[1:], len(at)) - 1] if len(at) else self.low  # last one
        self.mark = h[at[new]]

    def region_hash(self, which: np.ndarray) -> np.ndarray:
        return span_hash(self.prefix, self.low[which], self.high[which] + LENGTH)


PACKED = "pack long, docs binary, missing binary, sizes binary, texts binary"


def packs(docs: DataFrame, most: int = PACK) -> DataFrame:
    """The texts in compressed packs of ``most`` bytes, each a row; later passes name a pack by its number."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

        def row() -> pa.RecordBatch:
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            missing = np.packbits([d is None for d in ids]).tobytes()
            docs_ = np.array([NO_ID if d is None else d for d in ids], np.int64)
            one = {"pack": number, "docs": docs_.tobytes(), "missing": missing, "sizes": sizes.tobytes(), "texts": z.compress(b"".join(texts))}
            return pa.RecordBatch.from_pylist([one], schema=pa.schema([("pack", pa.int64()), *((c, pa.binary()) for c in ("docs", "missing", "sizes", "texts"))]))

        for batch in batches:
            for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids.append(d)
                texts.append(t := t.encode())
                size += len(t)
                if size >= most or len(ids) >= 1 << 16:
                    yield row()
                    number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield row()

    return documents(docs).mapInArrow(run, PACKED)


def _open(docs: bytes, sizes: bytes, texts: bytes) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """doc_ids and texts of a pack, in blocks."""
    size = np.frombuffer(sizes, np.int64)
    raw = zstandard.ZstdDecompressor().decompress(texts) if len(texts) else b""
    upto = np.concatenate(([0], np.cumsum(size))).tolist()
    ids, at = np.frombuffer(docs, np.int64), 0
    for block in blocks(raw[a:b] for a, b in zip(upto, upto[1:])):
        yield ids[at : at + len(block)], block
        at += len(block)


def _dealt(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by bucket, and where each of the n buckets begins in it."""
    bucket = (keys % U64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n + 1))


def _named(marks: np.ndarray, n: int) -> np.ndarray:
    """Anchors as their bucket and 32 bits more; two anchors that this takes for one only make more regions."""
    return (marks % U64(n)) << U64(32) | marks >> U64(32)


def _mark_rows(n: int):
    """(bucket, pack, marks, often, counts): a pack's distinct anchors in the bucket, which of them several of its documents have, and how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, *rest in zip(*(batch.column(c).to_pylist() for c in ("pack", "docs", "sizes", "texts"))):
                marks, owners = [], []
                for ids, block in _open(*rest):
                    a = Anchors(block)
                    marks.append(_named(a.mark, n))
                    owners.append(ids[a.doc])
                mark, owner = np.concatenate(marks), np.concatenate(owners)
                order = np.lexsort((owner, mark))
                mark, owner = mark[order], owner[order]
                fresh = np.concatenate(([True], (mark[1:] != mark[:-1]) | (owner[1:] != owner[:-1]))) if len(mark) else np.zeros(0, bool)
                one, count = np.unique(mark[fresh], return_counts=True)
                edge = np.searchsorted(one, np.arange(n + 1, dtype=U64) << U64(32))
                full = np.flatnonzero(np.diff(edge))
                low, several, rows = one.astype(np.uint32), np.flatnonzero(count > 1), []
                at = np.searchsorted(several, edge)
                for k in full.tolist():
                    w = several[at[k] : at[k + 1]]
                    rows.append((low[edge[k] : edge[k + 1]].tobytes(), (w - edge[k]).astype(np.uint32).tobytes(), count[w].astype(np.uint32).tobytes()))
                cols = list(zip(*rows)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(np.full(len(full), pack))] + [pa.array(c, pa.binary()) for c in cols], names=["bucket", "pack", "marks", "often", "counts"])

    return run


def _shared_marks(table: pa.Table) -> pa.Table:
    """Of a bucket, for each pack those of its anchors that more than one document has, and which of them are hot."""
    get = lambda c, i: np.frombuffer(table.column(c)[i].as_py(), np.uint32)
    rows = range(table.num_rows)
    marks = [get("marks", i) for i in rows]
    size = np.fromiter(map(len, marks), np.int64, len(marks))
    upto = np.concatenate(([0], np.cumsum(size)))
    whole, counts = np.concatenate(marks), np.ones(upto[-1], np.int64)
    for i in rows:
        counts[upto[i] + get("often", i)] = get("counts", i)
    order = np.argsort(whole, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], whole[order][1:] != whole[order][:-1])))
    total = np.add.reduceat(counts[order], first)
    many = np.empty(len(whole), np.int64)
    many[order] = np.repeat(total, np.diff(np.append(first, len(whole))))
    bucket, out = U64(table.column("bucket")[0].as_py()) << U64(32), []
    for i, p in enumerate(table.column("pack").to_pylist()):
        here = many[upto[i] : upto[i + 1]]
        if (here > 1).any():
            names = bucket | marks[i].astype(U64)
            out.append((p, names[(here > 1) & (here < HOT)].tobytes(), names[here >= HOT].tobytes()))
    cols = list(zip(*out)) or [[], [], []]
    return pa.table({"pack": pa.array(cols[0], pa.int64()), "marks": pa.array(cols[1], pa.binary()), "hot": pa.array(cols[2], pa.binary())})


def _joined_keys(column: pa.ChunkedArray) -> np.ndarray:
    return np.sort(np.frombuffer(b"".join(column.to_pylist()), U64))


def _inside(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def _region_rows(n: int):
    """(shard, pack, hot, hashes, sizes, docs, bytes): the distinct regions of a pack's shared anchors, with their smallest doc_id."""

    def run(pack: pa.Table, shared: pa.Table) -> pa.Table:
        empty = {"shard": pa.int32(), "pack": pa.int64(), "hot": pa.bool_(), "hashes": pa.binary(), "sizes": pa.binary(), "docs": pa.binary(), "bytes": pa.binary()}
        rows: list[tuple] = []
        if pack.num_rows and shared.num_rows:
            some, hot = _joined_keys(shared.column("marks")), _joined_keys(shared.column("hot"))
            hashes, keys, sizes, owners, texts, flags, more = [], [], [], [], [], [], []
            for ids, block in _open(*(pack.column(c)[0].as_py() for c in ("docs", "sizes", "texts"))):
                a = Anchors(block)
                name = _named(a.mark, n)
                is_hot = _inside(name, hot)
                which = np.flatnonzero(is_hot | _inside(name, some))
                h = a.region_hash(which)
                owner = ids[a.doc[which]]
                order = np.lexsort((owner, h))
                first = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1]))) if len(order) else order
                keep, last = order[first], order[np.append(first[1:], len(order)) - 1] if len(order) else order
                several = owner[keep] != owner[last]
                which, h = which[keep], h[keep]
                size = a.high[which] + LENGTH - a.low[which]
                more.append(several)
                hashes.append(h)
                flags.append(is_hot[which])
                keys.append(np.where(is_hot[which], h, a.mark[which]))
                sizes.append(size)
                owners.append(owner[keep])
                texts.append(a.data[ragged(a.low[which], size)])
            h, key, size, owner, data, flag, some_more = (np.concatenate(x) for x in (hashes, keys, sizes, owners, texts, flags, more))
            z = zstandard.ZstdCompressor(level=3)
            begin = np.cumsum(size) - size
            number = pack.column("pack")[0].as_py()
            for hot_ in (False, True):
                part = np.flatnonzero(flag == hot_)
                order, edge = _dealt(key[part], n)
                for k in np.flatnonzero(np.diff(edge)).tolist():
                    w = part[order[edge[k] : edge[k + 1]]]
                    rows.append((k, number, hot_, h[w].tobytes(), (size[w] | (some_more[w].astype(np.int64) << 7)).astype(np.uint8).tobytes(), z.compress(owner[w].tobytes()), z.compress(data[ragged(begin[w], size[w])].tobytes())))
        cols = list(zip(*rows)) or [[] for _ in empty]
        return pa.table({c: pa.array(x, t) for (c, t), x in zip(empty.items(), cols)})

    return run


class _Shard:
    """The distinct regions of a shard."""

    def __init__(self, table: pa.Table) -> None:
        self.packs = table.column("pack").to_pylist()
        hashes = [np.frombuffer(x, U64) for x in table.column("hashes").to_pylist()]
        self.count = np.fromiter(map(len, hashes), np.int64, len(hashes))
        self.hash = np.concatenate(hashes)
        size = np.frombuffer(b"".join(table.column("sizes").to_pylist()), np.uint8).astype(np.int64)
        self.several, size = size > 127, size & 127  # the high bit tells of more documents in the pack
        z = zstandard.ZstdDecompressor()
        owner = np.frombuffer(b"".join(map(z.decompress, table.column("docs").to_pylist())), np.int64)
        data = np.frombuffer(b"".join(map(z.decompress, table.column("bytes").to_pylist())), np.uint8)
        self.own = owner
        order = np.lexsort((owner, self.hash))
        first = np.concatenate(([True], self.hash[order][1:] != self.hash[order][:-1]))
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(first) - 1
        keep = order[first]
        self.size, self.doc = size[keep], owner[keep]
        self.end = np.cumsum(self.size)
        self.begin = self.end - self.size
        self.data = data[ragged((np.cumsum(size) - size)[keep], self.size)]

    def strings(self) -> np.ndarray:
        """Where the strings of all regions begin."""
        return ragged(self.begin, self.size - LENGTH + 1)

    def answer(self, low: np.ndarray) -> pa.Table:
        """(pack, hashes, docs, covered): for each region that matters its smallest doc and, as bits, which of that doc's strings an earlier one has."""
        n = self.size - LENGTH + 1
        at = self.strings()
        earlier = low[at] < np.repeat(self.doc, n)
        bit = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        bits = np.bitwise_or.reduceat(np.where(earlier, np.uint32(1) << bit.astype(np.uint32), np.uint32(0)), np.cumsum(n) - n)
        out, upto = [], np.concatenate(([0], np.cumsum(self.count)))
        for k, p in enumerate(self.packs):
            here = slice(upto[k], upto[k + 1])
            w = self.of[here]
            tells = (self.doc[w] < self.own[here]) | (bits[w] > 0) | self.several[here]
            w = w[tells]
            if not len(w):
                continue
            out.append((p, self.hash[here][tells].tobytes(), self.doc[w].tobytes(), bits[w].astype(np.uint32).tobytes()))
        cols = list(zip(*out)) or [[], [], [], []]
        return pa.table({"pack": pa.array(cols[0], pa.int64()), "hashes": pa.array(cols[1], pa.binary()), "docs": pa.array(cols[2], pa.binary()), "covered": pa.array(cols[3], pa.binary())})


#: A resolved shard: its answers, or for a hot one its sorted strings (range, shard, strings, docs) and its regions again.
RESOLVED = "kind string, shard int, pack long, range int, hashes binary, sizes binary, docs binary, covered binary, bytes binary"
_RESOLVED = pa.schema([("kind", pa.string()), ("shard", pa.int32()), ("pack", pa.int64()), ("range", pa.int32()), *((c, pa.binary()) for c in ("hashes", "sizes", "docs", "covered", "bytes"))])
ANSWER = "pack long, hashes binary, docs binary, covered binary"


def _resolved(kind: str, table: pa.Table) -> pa.Table:
    """The table with the columns of RESOLVED; what it lacks is null."""
    n = table.num_rows
    own = {c: table.column(c) for c in table.column_names} | {"kind": pa.array([kind] * n, pa.string())}
    return pa.table([own[f.name] if f.name in own else pa.nulls(n, f.type) for f in _RESOLVED], schema=_RESOLVED)


def _resolve(n: int):
    """Answers of a shard, or its share of the merge over n ranges."""

    def run(table: pa.Table) -> pa.Table:
        s = _Shard(table)
        low = smallest_owner(s.data, s.begin, s.end, s.doc)
        if not table.column("hot")[0].as_py():
            return _resolved("answer", s.answer(low))
        at = s.strings()
        h = span_hash(prefix_hash(s.data), at, at + LENGTH)
        _, one = np.unique(h, return_index=True)
        order, edge = _dealt(h[one], n)
        shard, rows = table.column("shard")[0].as_py(), []
        for k in np.flatnonzero(np.diff(edge)).tolist():
            w = at[one[order[edge[k] : edge[k + 1]]]]
            text = s.data[w[:, None] + np.arange(LENGTH)]
            turn = np.argsort(_sortable(text), kind="stable")
            rows.append((k, shard, text[turn].tobytes(), low[w][turn].tobytes()))
        cols = list(zip(*rows)) or [[], [], [], []]
        runs = pa.table({"range": pa.array(cols[0], pa.int32()), "shard": pa.array(cols[1], pa.int32()), "bytes": pa.array(cols[2], pa.binary()), "docs": pa.array(cols[3], pa.binary())})
        again = table.select(["shard", "pack", "hashes", "sizes", "docs", "bytes"])
        return pa.concat_tables([_resolved("run", runs), _resolved("regions", again)])

    return run


def _sortable(strings: np.ndarray) -> np.ndarray:
    """Strings of LENGTH bytes as fixed-size byte strings with a last byte, so that zero bytes at the end count."""
    table = np.frombuffer(strings.tobytes(), np.uint8).reshape(-1, LENGTH)
    wide = np.ones((len(table), LENGTH + 1), np.uint8)
    wide[:, :LENGTH] = table
    return wide.view(f"S{LENGTH + 1}").ravel()


def _merge_runs(table: pa.Table) -> pa.Table:
    """The sorted strings of several shards: each is looked up in the others by binary search; returns each shard its smallest docs."""
    shards = table.column("shard").to_pylist()
    runs = [_sortable(np.frombuffer(x, np.uint8)) for x in table.column("bytes").to_pylist()]
    docs_ = [np.frombuffer(x, np.int64) for x in table.column("docs").to_pylist()]
    known, low = runs[0], docs_[0].copy()
    for run, doc in zip(runs[1:], docs_[1:]):
        at = np.searchsorted(known, run)
        same = (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == run)
        low[at[same]] = np.minimum(low[at[same]], doc[same])
        known, low = np.insert(known, at[~same], run[~same]), np.insert(low, at[~same], doc[~same])
    out = [low[np.searchsorted(known, run)].tobytes() for run in runs]
    return pa.table({"shard": pa.array(shards, pa.int32()), "strings": table.column("bytes"), "docs": pa.array(out, pa.binary())})


def _resolve_hot(table: pa.Table, merged: pa.Table) -> pa.Table:
    if not table.num_rows:
        return pa.table({"pack": pa.array([], pa.int64()), **{c: pa.array([], pa.binary()) for c in ("hashes", "docs", "covered")}})
    s = _Shard(table)
    strings = np.concatenate([np.frombuffer(x, np.uint8) for x in merged.column("strings").to_pylist()])
    docs_ = np.concatenate([np.frombuffer(x, np.int64) for x in merged.column("docs").to_pylist()])
    begin = np.arange(len(docs_)) * LENGTH
    h = span_hash(prefix_hash(strings), begin, begin + LENGTH)
    order = np.argsort(h)
    at = s.strings()
    own = span_hash(prefix_hash(s.data), at, at + LENGTH)
    low = np.full(len(s.data), np.iinfo(np.int64).max)
    low[at] = docs_[order[np.searchsorted(h[order], own)]]
    return s.answer(low)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cut(keep_text: bool):
    def run(pack: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        if pack.num_rows:
            h, doc, bits = (np.frombuffer(b"".join(answers.column(c).to_pylist()), t) for c, t in (("hashes", U64), ("docs", np.int64), ("covered", np.uint32)))
            order = np.argsort(h, kind="stable")
            h, doc, bits = h[order], doc[order], bits[order]
            missing, done = np.unpackbits(np.frombuffer(pack.column("missing")[0].as_py(), np.uint8)), 0
            for ids, block in _open(*(pack.column(c)[0].as_py() for c in ("docs", "sizes", "texts"))):
                a = Anchors(block)
                edge = np.zeros(len(a.data) + 1, np.int32)
                if len(h) and len(a.low):
                    mine = a.region_hash(np.arange(len(a.low)))
                    at = np.minimum(np.searchsorted(h, mine), len(h) - 1)
                    known = np.flatnonzero(h[at] == mine)
                    at, owner = at[known], ids[a.doc[known]]
                    later = doc[at] < owner  # an earlier document has the whole region
                    np.add.at(edge, a.low[known[later]], 1)
                    np.add.at(edge, a.high[known[later]] + LENGTH, -1)
                    rest = np.flatnonzero(~later & (bits[at] > 0))
                    for k in range(_WINDOW):
                        w = a.low[known[rest[(bits[at[rest]] >> np.uint32(k)) & np.uint32(1) > 0]]] + k
                        np.add.at(edge, w, 1)
                        np.add.at(edge, w + LENGTH, -1)
                gone = np.cumsum(edge[:-1]) > 0
                rises = np.concatenate(([gone[0]], gone[1:] & ~gone[:-1])) if len(gone) else gone
                upto, spans = np.concatenate(([0], np.cumsum(gone))), np.concatenate(([0], np.cumsum(rises)))
                b, e = a.begin, a.end
                removed, many = upto[e] - upto[b], spans[e] - spans[b]
                for k, t in enumerate(block):
                    kept = t if not removed[k] else a.data[b[k] : e[k]][~gone[b[k] : e[k]]].tobytes()
                    out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                    out["kept"].append(kept if keep_text else None)
                out["doc_id"] += [None if gone_ else d for d, gone_ in zip(ids.tolist(), missing[done:].tolist())]
                done += len(block)
                out["n_bytes"] += (e - b).tolist()
                out["n_removed"] += removed.tolist()
                out["n_spans"] += many.tolist()
        kinds = (pa.int64(),) * 4 + (pa.string(), pa.binary())
        return pa.table({c: pa.array(x, t) for (c, x), t in zip(out.items(), kinds)})

    return run


def remove_repeats(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``keep_text``, the bytes that stay."""
    bytes_ = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # A pack sends a row to each bucket, so packs grow with the square root of the input, up to what a task can hold.
    stored = materialize(packs(docs, int(min(max(PACK, PACK * (bytes_ / PACKS) ** 0.5), MOST))), "packs")
    n = max(1, -(-bytes_ // BUCKET))
    marks = stored.mapInArrow(_mark_rows(n), "bucket int, pack long, marks binary, often binary, counts binary")
    shared = materialize(marks.groupBy("bucket").applyInArrow(_shared_marks, "pack long, marks binary, hot binary"), "shared")
    kind = "shard int, pack long, hot boolean, hashes binary, sizes binary, docs binary, bytes binary"
    regions = stored.groupBy("pack").cogroup(shared.groupBy("pack")).applyInArrow(_region_rows(n), kind)
    resolved = materialize(regions.groupBy("shard", "hot").applyInArrow(_resolve(n), RESOLVED), "resolved")
    discard(shared)
    answers = resolved.filter("kind = 'answer'").select("pack", "hashes", "docs", "covered")
    merged = resolved.filter("kind = 'run'").select("range", "shard", "bytes", "docs").groupBy("range").applyInArrow(_merge_runs, "shard int, strings binary, docs binary")
    hot = resolved.filter("kind = 'regions'").select("shard", "pack", "hashes", "sizes", "docs", "bytes")
    hot = materialize(hot.groupBy("shard").cogroup(merged.groupBy("shard")).applyInArrow(_resolve_hot, ANSWER), "hot")
    out = stored.groupBy("pack").cogroup(answers.union(hot).groupBy("pack")).applyInArrow(_cut(keep_text), RESULT)
    return out
