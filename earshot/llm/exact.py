"""Exact deduplication against immutable snapshots screened by binary fuse filters.

A snapshot's digests are dealt into buckets, each with one static filter.  The
distinct digests of an incoming batch are screened by the filter of their
bucket; only positives, and digests that repeat within one batch, go on to the
byte check, which groups whole texts.  Everything else is new.  Rows are
pre-aggregated before each shuffle, so a group that holds a third of all rows
is as cheap as any other.

Defined cases: null texts equal empty ones; texts of any length are compared
whole; of equal texts the smallest doc_id stays, and rows that repeat that
doc_id all stay; a row without doc_id is in no group and stays; an empty table gives an empty result; other columns are not
read, so their names can't clash.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import documents, join_even, materialize, packed
from .vectext import U64, mix

#: Digests that a bucket's filter holds on average.
BUCKET = 1 << 16
_HEAD = struct.Struct("<QIII")  # seed, keys, log2 of a segment, segments


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space."""
    return F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " ")


def _slots(h: np.ndarray, shift: int, segments: int) -> np.ndarray:
    """Three slots of each hash, in neighbouring segments."""
    first = ((h >> U64(32)) * U64(segments - 2)) >> U64(32)
    out = np.empty((len(h), 3), np.int64)
    mask = U64((1 << shift) - 1)
    for k, g in enumerate((h, mix(h ^ U64(1)), mix(h ^ U64(2)))):
        out[:, k] = ((first + U64(k)) << U64(shift)) | (g & mask)
    return out


def build_filter(keys: np.ndarray) -> bytes:
    """A static binary fuse filter of distinct 64-bit keys with 16-bit fingerprints."""
    n = len(keys)
    shift = max(3, int(np.log(max(n, 2)) / np.log(3.33) + 2.25))
    for seed in range(1, 200):
        want = int(max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 3))) * n * (1 + seed // 20 * 0.1)) + (1 << shift)
        segments = max(3, -(-want // (1 << shift)) + 2)
        size = segments << shift
        h = mix(keys + U64(seed) * U64(0x9E3779B97F4A7C15))
        slots = _slots(h, shift, segments)
        count, held = np.zeros(size, np.int32), np.zeros(size, np.int64)
        for k in range(3):
            np.add.at(count, slots[:, k], 1)
            np.bitwise_xor.at(held, slots[:, k], np.arange(n))
        rounds, left = [], n
        look = np.flatnonzero(count == 1)
        while len(look):
            key = held[look]
            key, one = np.unique(key, return_index=True)
            at = look[one]
            rounds.append((key, at))
            left -= len(key)
            flat = slots[key].ravel()
            np.subtract.at(count, flat, 1)
            np.bitwise_xor.at(held, flat, np.repeat(key, 3))
            look = np.unique(flat)
            look = look[count[look] == 1]
        if not left:
            break
    else:
        raise ValueError("keys of a static filter must be distinct")
    table = np.zeros(size, np.uint16)
    mark = mix(h ^ U64(3)).astype(np.uint16)
    for key, at in reversed(rounds):
        table[at] = 0
        table[at] = mark[key] ^ table[slots[key, 0]] ^ table[slots[key, 1]] ^ table[slots[key, 2]]
    return _HEAD.pack(seed, n, shift, segments) + table.tobytes()


def may_contain(filter_: bytes, keys: np.ndarray) -> np.ndarray:
    """False where the filter surely lacks the key."""
    seed, n, shift, segments = _HEAD.unpack_from(filter_)
    if not n:
        return np.zeros(len(keys), bool)
    table = np.frombuffer(filter_, np.uint16, offset=_HEAD.size)
    h = mix(keys + U64(seed) * U64(0x9E3779B97F4A7C15))
    slots = _slots(h, shift, segments)
    return mix(h ^ U64(3)).astype(np.uint16) == table[slots[:, 0]] ^ table[slots[:, 1]] ^ table[slots[:, 2]]


def snapshot_filters(digests: DataFrame) -> DataFrame:
    """One filter for each bucket of a snapshot's distinct digests (bucket, key)."""

    def run(table: pa.Table) -> pa.Table:
        keys = np.unique(table.column("key").to_numpy().view(U64))
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "filter": pa.array([build_filter(keys)], pa.binary())})

    return digests.select("bucket", "key").groupBy("bucket").applyInArrow(run, "bucket int, filter binary")


def screen(incoming: DataFrame, filters: DataFrame) -> DataFrame:
    """Those of the incoming distinct digests (bucket, key, sha) that a snapshot may hold."""

    def run(new: pa.Table, known: pa.Table) -> pa.Table:
        if not known.num_rows or not new.num_rows:
            return new.select(["sha"]).slice(0, 0)
        hit = may_contain(known.column("filter")[0].as_py(), new.column("key").to_numpy().view(U64))
        return new.select(["sha"]).filter(pa.array(hit))

    return incoming.select("bucket", "key", "sha").groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(run, "sha string")


def groups(docs: DataFrame, incoming: Column | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, sha (of the normalised text), keep_id and group_size.

    ``incoming`` says which rows are the new batch; the others are the immutable
    snapshot.  Without it, half of the rows by a hash of their doc_id are.  The
    digests of both sides are grouped apart.  The snapshot's make filters and
    exact buckets; the batch is screened, and only its positives meet the
    buckets.  Digests that one side holds several times are known from its own
    groups.
    """
    if incoming is None:
        incoming = F.pmod(F.xxhash64(F.lit("batch"), "doc_id"), F.lit(2)) == 1
    texts = documents(docs.withColumn("_new", incoming), "doc_id", "text", "_new").withColumn("_norm", normalised(F.col("text")))
    texts = texts.select("doc_id", "_new", "_norm", F.sha2("_norm", 256).alias("sha"))
    rows = materialize(texts.select("doc_id", "_new", "sha"), "digests")
    texts, known = texts.filter("doc_id is not null"), rows.filter("doc_id is not null")
    buckets = max(1, -(-rows.count() // BUCKET))
    key = F.xxhash64("sha")

    def side(new: bool) -> DataFrame:
        each = known.filter(F.col("_new") if new else ~F.col("_new")).groupBy("sha").agg(F.count("*").alias("many")).withColumn("key", key)
        return materialize(each.withColumn("bucket", F.pmod(F.xxhash64(F.lit("bucket"), "key"), F.lit(buckets)).cast("int")), "batch" if new else "snapshot")

    snapshot, batch = side(False), side(True)
    filters = materialize(snapshot_filters(snapshot), "filters")
    positive = materialize(screen(batch, filters), "positives")
    across = join_even(positive, snapshot.select("sha"), ["sha"])  # a filter's false positives have no bucket
    within = snapshot.filter("many > 1").select("sha").union(batch.filter("many > 1").select("sha"))
    checked = materialize(across.union(within).distinct(), "several")
    # Byte check: whole texts are the grouping key, so only equal bytes meet.
    same = join_even(texts, checked, ["sha"]).groupBy("sha", "_norm").agg(F.min("doc_id").alias("_keep"), F.count("*").alias("_n"))
    same = same.groupBy("sha").agg(F.min("_keep").alias("_keep"), F.sum("_n").alias("_n"), F.count("*").alias("_texts"))
    broken = F.raise_error(F.lit("two texts share a SHA-256 digest"))
    same = materialize(same.select("sha", F.when(F.col("_texts") > 1, broken.cast("bigint")).otherwise(F.col("_keep")).alias("_keep"), "_n"), "groups")
    out = join_even(rows, same, ["sha"], "left")
    return out.select("doc_id", "sha", F.when(F.col("doc_id").isNotNull(), F.coalesce("_keep", "doc_id")).alias("keep_id"), F.when(F.col("doc_id").isNotNull(), F.coalesce("_n", F.lit(1))).otherwise(F.lit(1)).alias("group_size"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns; a row is known by its doc_id and 64 bits of its text's digest."""
    gone = materialize(groups(docs).filter("doc_id <> keep_id").select(F.col("doc_id").alias("_doc"), F.xxhash64("sha").alias("_sha")).distinct(), "gone")
    sha = F.sha2(normalised(F.coalesce(F.col("text"), F.lit(""))), 256)
    keyed = packed(docs, _doc=F.col("doc_id"), _sha=F.xxhash64(sha))
    return keyed.join(gone, ["_doc", "_sha"], "left_anti").select("_row.*")


__all__ = ["build_filter", "deduplicate", "groups", "may_contain", "normalised", "screen", "snapshot_filters"]
