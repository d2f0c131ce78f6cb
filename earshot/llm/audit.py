"""How filters of a corpus act together, in every order, from a packed bitmap index.

Each task packs which of its rows fail a filter, and which carry a label, into
bitsets of 64-bit words.  Rows are sorted by part first and every part begins a
new word, so a part is a run of words, and one more bitset marks its rows.  What
stays after a set of filters is the marks AND NOT each of its bitsets; counts of
ones for all sets, summed over the tasks, give every order of the filters: what
a step removes is the difference of two sets.

Only digests, bits and parts leave the task that reads a text.  A text that
holds a third of all rows meets its smallest doc_id by pre-aggregated digests
and a join that adaptive execution can split.

Defined cases: a null text counts as empty, a null part is the empty string;
texts of any length are read whole; rows that repeat a doc_id count each, and
none of them is an earlier copy of another; a row without doc_id has no earlier
copy, is none and has no labels; of repeated or null labels a document has those
that any row gives it; an empty table gives an empty result; helpers read named
columns only, so other names can't clash.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import documents, join_even, materialize, small_batches

#: Fixed values of the filters: fewest words, least percentage of distinct words, most percentage of capitals, odd characters.
FEWEST, DISTINCT, CAPITALS, ODD = 200, 50, 2, b"#$%&*|"
FILTERS = ("A", "B", "C", "D", "E")
LABELS = ("good", "toxic")
#: Rows that are packed together.
BLOCK = 1 << 16
#: Longer texts are cut into words one at a time.
LONG = 1 << 22
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_CAPITALS = bytes(range(65, 91))


def _words(text: bytes) -> tuple[int, int]:
    """Words of a text, and distinct ones."""
    if len(text) <= LONG:
        words = text.split()
        return len(words), len(set(words))
    n, seen = 0, set()
    for m in _WORD.finditer(text):
        n += 1
        seen.add(m[0])
    return n, len(seen)


def facts(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, part (its source), whether it fails A to D, and the SHA-256 of its text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            points = pc.utf8_length(text).to_numpy(zero_copy_only=False)
            bits, digest = np.zeros((4, len(points)), bool), []
            for k, raw in enumerate(text.cast(pa.binary()).to_pylist()):
                n, distinct = _words(raw)
                capitals = len(raw) - len(raw.translate(None, _CAPITALS))
                bits[:, k] = n < FEWEST, 100 * distinct < DISTINCT * n, 100 * capitals > CAPITALS * points[k], len(raw.translate(None, ODD)) < len(raw)
                digest.append(hashlib.sha256(raw).digest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), *map(pa.array, bits), pa.array(digest, pa.binary())], names=["doc_id", "part", *FILTERS[:4], "digest"])

    rows = documents(docs, "doc_id", "text", "source").select("doc_id", "text", F.coalesce("source", F.lit("")).alias("part"))
    return rows.mapInArrow(run, "doc_id long, part string, A boolean, B boolean, C boolean, D boolean, digest binary")


def with_copies(rows: DataFrame) -> DataFrame:
    """``rows`` of ``facts`` with E: whether a smaller doc_id has the same text."""
    first = rows.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("many"))
    first = materialize(first.filter("many > 1").select("digest", "first"), "first")
    return join_even(rows, first, ["digest"], "left").withColumn("E", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))).drop("first", "digest")


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with good (quality 1) and toxic (toxic 1) from ``labels``."""
    own = labels.filter("doc_id is not null").groupBy("doc_id")
    own = own.agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))])
    out = join_even(rows, own, ["doc_id"], "left", merge=False)
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in LABELS})


def _packed(part: pa.Array, flags: np.ndarray) -> list[pa.Array]:
    """One row for each part of a block: its number of rows, and the bitsets of its marks and of each row of ``flags``."""
    coded = part.dictionary_encode()
    index, names = coded.indices.to_numpy(), coded.dictionary
    order = np.argsort(index, kind="stable")
    many = np.bincount(index, minlength=len(names))
    words = -(-many // 64)
    first = np.concatenate(([0], np.cumsum(words)))
    at = np.arange(len(index)) + np.repeat(64 * first[:-1] - (np.cumsum(many) - many), many)
    upto = pa.py_buffer((8 * first).astype(np.int32))
    columns = [names.cast(pa.string()), pa.array(many, pa.int64())]
    for row in (np.ones(len(index), bool), *flags):
        bits = np.zeros(64 * first[-1], bool)
        bits[at] = row[order]
        columns.append(pa.Array.from_buffers(pa.binary(), len(names), [None, upto, pa.py_buffer(np.packbits(bits, bitorder="little"))]))
    return columns


def bitmap_index(rows: DataFrame, flags: Sequence[str] = FILTERS + LABELS) -> DataFrame:
    """The index of ``rows`` (part and boolean ``flags``): for each part and block of a task, n, the bitset marks and one for each flag."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def packed() -> pa.RecordBatch:
            block = pa.Table.from_batches(held).combine_chunks()
            bits = np.array([block.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in flags])
            return pa.RecordBatch.from_arrays(_packed(block.column("part").combine_chunks(), bits), names=["part", "n", "marks", *flags])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK:
                yield packed()
                held, n = [], 0
        if n:
            yield packed()

    bitsets = ", ".join(f"`{c}` binary" for c in ("marks", *flags))
    return rows.select("part", *flags).mapInArrow(run, f"part string, n long, {bitsets}")


def subset_counts(index: DataFrame, filters: Sequence[str] = FILTERS, labels: Sequence[str] = LABELS) -> DataFrame:
    """Per part and set of filters (subset, bit k for the k-th): kept rows, and those of each label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            words = {c: np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u8") for c in ("marks", *filters, *labels)}
            size = pc.binary_length(batch.column("marks")).to_numpy() // 8
            first = np.cumsum(size) - size
            kept: list[np.ndarray] = []
            for subset in range(1 << len(filters)):
                top = subset.bit_length() - 1  # the set without its last filter came before
                kept.append(words["marks"] if not subset else kept[subset & ~(1 << top)] & ~words[filters[top]])
                counts = [np.add.reduceat(np.bitwise_count(x), first, dtype=np.int64) for x in (kept[-1], *[kept[-1] & words[c] for c in labels])]
                yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(np.full(len(first), subset, np.int32)), *map(pa.array, counts)], names=["part", "subset", "kept", *labels])

    found = index.mapInArrow(run, "part string, subset int, kept long, " + ", ".join(f"`{c}` long" for c in labels))
    return found.groupBy("part", "subset").agg(*[F.sum(c).alias(c) for c in ("kept", *labels)])


def steps(counts: DataFrame, filters: Sequence[str] = FILTERS, labels: Sequence[str] = LABELS) -> DataFrame:
    """Per part, order of the filters and step: kept, removed, redundant, unique_fails, ..._lost for each label, and shapley."""
    k = len(filters)
    orders = list(itertools.permutations(range(k)))
    which = np.array(orders).ravel()
    after = np.cumsum(1 << np.array(orders), axis=1).ravel()
    before, everything = after - (1 << which), (1 << k) - 1
    order = pa.array(np.repeat(["".join(filters[i] for i in o) for o in orders], k))
    step = pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), math.factorial(k)))
    lost = [f"{c}_lost" for c in labels]
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *lost, "shapley"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in zip(batch.column("part").to_pylist(), batch.column("sets").to_pylist()):
                n = np.zeros((1 + len(labels), 1 << k), np.int64)
                for s in sets:
                    n[:, s["subset"]] = [s[c] for c in ("kept", *labels)]
                all_ = n[0]
                removed = all_[before] - all_[after]
                fails = all_[0] - all_[1 << which]
                whole = np.zeros(k, np.int64)
                np.add.at(whole, which, removed)
                columns = [all_[after], removed, fails - removed, all_[everything ^ (1 << which)] - all_[everything], *(n[1:, before] - n[1:, after]), whole[which]]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(which)), order, step, *map(pa.array, columns)], names=names)

    sets = counts.groupBy("part").agg(F.collect_list(F.struct("subset", "kept", *labels)).alias("sets"))  # 2**k small rows for each part
    return sets.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"`{c}` long" for c in names[3:]))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``steps`` of the five filters over ``docs``, for each source."""
    rows = with_labels(with_copies(materialize(facts(docs), "facts")), labels)
    return steps(subset_counts(materialize(bitmap_index(rows), "bitmaps")))
