"""Byte-level BPE encoding and decoding of whole documents.

Pieces come from the pattern of the rank file; each unknown piece is encoded by
a segment tree over its byte positions (``bpe.py``) and remembered in a bounded
table of the Python worker.  Of a text with a code point of class ODD (``pretok.py``)
the part around it, up to a space between ASCII words, is encoded by tiktoken.  Ids and decoded bytes are the operator's outputs.

Defined cases: a null or empty text has no ids and decodes to no bytes; texts
of any length are encoded whole; repeated rows each give a row; an empty table
gives an empty result; other columns of ``docs`` are not read, so their names
can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe
from .encode import char_blocks, ids_of
from .session import documents, small_batches

ENCODED = "doc_id long, n_tokens long, ids binary, decoded binary"


def binaries(data: np.ndarray, upto: np.ndarray) -> pa.Array:
    """A binary column whose i-th value is data[upto[i]:upto[i+1]]."""
    offsets = pa.py_buffer(np.ascontiguousarray(upto, np.int32))
    return pa.Array.from_buffers(pa.binary(), len(upto) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(data))])


def _encode(path: str, pattern: str, decode: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = bpe.rank_file(path)
        for batch in batches:
            texts, doc = batch.column("text").to_pylist(), batch.column("doc_id")
            for k, part in char_blocks(texts):
                ids, n = ids_of(part, path, pattern)
                upto = np.concatenate(([0], np.cumsum(n)))
                columns = [doc.slice(k, len(part)), pa.array(n, pa.int64()), binaries(ids.astype("<u4").view(np.uint8), 4 * upto)]
                if decode:
                    wide = np.concatenate(([0], np.cumsum(vocabulary.size[ids])))
                    columns.append(binaries(vocabulary.decode(ids), wide[upto]))
                else:
                    columns.append(pa.nulls(len(part), pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", "decoded"])

    return run


def encode(docs: DataFrame, path: str, pattern: str, decode: bool = True) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, the ids as little-endian unsigned 32-bit integers, and the bytes they decode to."""
    small_batches(docs.sparkSession)
    return documents(docs).mapInArrow(_encode(path, pattern, decode), ENCODED)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Per row with doc_id and ids: doc_id and the decoded bytes.

    Null or empty ids decode to no bytes, an id that the vocabulary lacks is an
    error; repeated rows each give a row, an empty table none, and other columns
    are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = bpe.rank_file(path)
        for batch in batches:
            out = [vocabulary.decode(np.frombuffer(x or b"", "<u4")).tobytes() for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")
