"""Token-id files: bit-plane shuffled blocks, each plane compressed, with a chunk index.

A segment is self-contained: blocks of a fixed number of ids, each turned into
byte planes (all first bytes, then all second bytes, ...) or bit planes, every
plane compressed with zstandard; a directory of its documents; and a footer
that indexes where each block and plane lies, so a range of ids is read by
decompressing only its blocks.  On a cluster, segments are rows of a Parquet
table in shared storage, numbered by part and place in ascending doc_id order;
``write_file`` and ``read_file`` keep one segment as a plain file.

Defined cases: a null or empty text has the end id only; a document never spans
segments, so a very long one makes a longer segment; repeated rows of a doc_id
each get their own ids, next to each other; rows
without doc_id come first; an empty table writes no segment;
other columns of ``docs`` are not read, so their names can't clash.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .encode import char_blocks, ids_of
from .session import documents, shared_dir, small_batches
from .vectext import ragged

MAGIC = b"EBP1"
#: Ids in a block; ids after which a segment ends.
BLOCK_IDS, SEGMENT_IDS = 1 << 16, 1 << 20
#: Bytes of text in one range of doc_ids.
RANGE_BYTES = 24 << 20
_HEAD = struct.Struct("<4sBBIQQI")  # magic, bytes an id, planes a block, ids a block, ids, documents, blocks


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The planes of a block of ids: plane k has the k-th byte (or bit) of every id."""
    table = np.ascontiguousarray(ids).view(np.uint8).reshape(len(ids), ids.dtype.itemsize)
    if not bits:
        return [np.ascontiguousarray(table[:, k]).tobytes() for k in range(table.shape[1])]
    flags = np.unpackbits(table, axis=1, bitorder="little")
    return [np.packbits(flags[:, k], bitorder="little").tobytes() for k in range(flags.shape[1])]


def from_planes(planes: list[bytes], n: int, width: int, bits: bool) -> np.ndarray:
    if not bits:
        table = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        flags = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), bitorder="little")[:n] for p in planes], axis=1)
        table = np.packbits(flags, axis=1, bitorder="little")
    return np.ascontiguousarray(table).view(f"<u{width}").ravel()


def pack(ids: np.ndarray, doc_ids: np.ndarray, counts: np.ndarray, bits: bool = False, block: int = BLOCK_IDS, missing: np.ndarray | None = None) -> bytes:
    """A segment of documents whose ids stand one after the other; ``missing`` marks those without doc_id."""
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    ids = ids.astype(f"<u{width}")
    z = zstandard.ZstdCompressor(level=3)
    chunks = [z.compress(p) for k in range(0, len(ids), block) for p in to_planes(ids[k : k + block], bits)]
    missing = np.zeros(len(doc_ids), bool) if missing is None else missing
    directory = z.compress(doc_ids.astype("<i8").tobytes() + counts.astype("<i8").tobytes() + np.packbits(missing).tobytes())
    planes = width * (8 if bits else 1)
    head = _HEAD.pack(MAGIC, width, planes, block, len(ids), len(doc_ids), len(chunks) // planes)
    index = np.fromiter(map(len, [*chunks, directory]), "<u4", len(chunks) + 1)
    return b"".join([head, *chunks, directory, index.tobytes()])


class Segment:
    """Reader of a packed segment."""

    def __init__(self, payload: bytes) -> None:
        magic, self.width, self.planes, self.block, self.n_ids, self.n_docs, blocks = _HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a segment of token ids")
        n = blocks * self.planes + 1
        size = np.frombuffer(payload[len(payload) - 4 * n :], "<u4").astype(np.int64)
        self.at = _HEAD.size + np.concatenate(([0], np.cumsum(size)))
        self.payload = payload

    def _chunk(self, k: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self.payload[self.at[k] : self.at[k + 1]])

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        """doc_id and number of ids of each document, in order."""
        both = np.frombuffer(self._chunk(len(self.at) - 2), "<i8", 2 * self.n_docs)
        return both[: self.n_docs], both[self.n_docs :]

    def missing(self) -> np.ndarray:
        """Which documents have no doc_id."""
        bits = np.frombuffer(self._chunk(len(self.at) - 2), np.uint8, offset=16 * self.n_docs)
        return np.unpackbits(bits, count=self.n_docs).astype(bool)

    def read(self, start: int = 0, count: int | None = None) -> np.ndarray:
        """Ids start to start + count; only the blocks that hold them are decompressed."""
        stop = self.n_ids if count is None else min(self.n_ids, start + count)
        if start >= stop:
            return np.zeros(0, f"<u{self.width}")
        first, out = start // self.block, []
        for k in range(first, (stop - 1) // self.block + 1):
            n = min(self.block, self.n_ids - k * self.block)
            planes = [self._chunk(k * self.planes + p) for p in range(self.planes)]
            out.append(from_planes(planes, n, self.width, self.planes > self.width))
        return np.concatenate(out)[start - first * self.block : stop - first * self.block]


def write_file(path: str, ids: np.ndarray, doc_ids: np.ndarray, counts: np.ndarray, bits: bool = False) -> None:
    with open(path, "wb") as f:
        f.write(pack(ids, doc_ids, counts, bits))


def read_file(path: str) -> Segment:
    with open(path, "rb") as f:
        return Segment(f.read())


SEGMENTS = "part int, place int, n_docs long, n_ids long, payload binary"


def write_ids(docs: DataFrame, path: str, end_id: int, to: str | None = None, bits: bool = False) -> str:
    """Encode all texts, append ``end_id`` to each, and write segments in ascending doc_id order; returns where they are."""
    spark = docs.sparkSession
    small_batches(spark)
    to = to or f"{shared_dir(spark)}/earshot-ids-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, held, docs_, counts, lacks, size = TaskContext.get().partitionId(), 0, [], [], [], [], 0

        def segment() -> pa.RecordBatch:
            all_docs, all_counts = np.concatenate(docs_), np.concatenate(counts)
            payload = pack(np.concatenate(held), all_docs, all_counts, bits, missing=np.concatenate(lacks))
            return pa.RecordBatch.from_pylist([{"part": part, "place": place, "n_docs": len(all_docs), "n_ids": size, "payload": payload}], schema=pa.schema([("part", pa.int32()), ("place", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())]))

        for batch in batches:
            texts, doc, lack = batch.column("text").to_pylist(), batch.column("doc_id").fill_null(0).to_numpy(), batch.column("doc_id").is_null().to_numpy(False)
            for k, some in char_blocks(texts):
                ids, n = ids_of(some, path)
                whole = np.full(len(ids) + len(n), end_id, np.uint32)
                begin = np.cumsum(n + 1) - (n + 1)
                whole[ragged(begin, n)] = ids
                held.append(whole)
                docs_.append(doc[k : k + len(some)])
                lacks.append(lack[k : k + len(some)])
                counts.append(n + 1)
                size += len(whole)
                if size >= SEGMENT_IDS:
                    yield segment()
                    place, held, docs_, counts, lacks, size = place + 1, [], [], [], [], 0
        if held:
            yield segment()

    rows = documents(docs)
    ranges = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // RANGE_BYTES))
    # The row's place breaks ties, so that a doc_id that very many rows repeat is dealt over ranges too.
    keyed = rows.withColumn("_row", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange(ranges, "doc_id", "_row").sortWithinPartitions("doc_id", "_row").drop("_row")
    ordered.mapInArrow(run, SEGMENTS).write.parquet(to)
    return to


def read_ids(spark: SparkSession, at: str) -> DataFrame:
    """Per document in the files: doc_id, start (ids of all documents before it), n_tokens and its ids as little-endian unsigned 32-bit integers."""
    stored = spark.read.schema(SEGMENTS).parquet(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .bytebpe import binaries

        for batch in batches:
            for part, place, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "place", "payload"))):
                s = Segment(payload)
                doc, n = s.documents()
                lack = s.missing()
                upto = np.concatenate(([0], np.cumsum(n)))
                ids = s.read().astype("<u4")
                step = 2048
                for k in range(0, len(doc), step):
                    some = upto[k : k + step + 1]
                    m = len(some) - 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(m, part, np.int32)), pa.array(np.full(m, place, np.int32)), pa.array(doc[k : k + step], mask=lack[k : k + step]), pa.array(some[:-1]), pa.array(n[k : k + step]), binaries(ids[some[0] : some[-1]].view(np.uint8), 4 * (some - some[0]))],
                        names=["part", "place", "doc_id", "within", "n_tokens", "ids"],
                    )

    found = stored.select("part", "place", "payload").mapInArrow(run, "part int, place int, doc_id long, within long, n_tokens long, ids binary")
    sizes = stored.select("part", "place", "n_ids")
    before = sizes.withColumn("here", F.sum("n_ids").over(Window.partitionBy("part").orderBy("place")) - F.col("n_ids"))
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("whole"))  # one row for each written part
    parts = parts.select("part", (F.sum("whole").over(Window.orderBy("part")) - F.col("whole")).alias("ahead"))
    base = before.join(parts, "part").select("part", "place", (F.col("ahead") + F.col("here")).alias("base"))
    return found.join(base, ["part", "place"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids")
