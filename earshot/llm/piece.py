"""SentencePiece encoding and decoding of whole documents by a table of distinct chunks.

Where no piece of the vocabulary has anything before a white-space marker, no
merge crosses from one marked word to the next, so a text is cut before each run
of markers and the chunks are segmented apart.  Each task keeps a bounded table
of distinct chunks: one that it has seen gives its ids back, a new one is
segmented once, and the ids are joined in the order of the positions.  For a
model whose pieces do cross markers a chunk is the whole text.

Defined cases: a null or empty text has the begin and end ids only and decodes
to nothing; a marker character in a text counts as a space, as the library
takes it, so it decodes to one; texts and words of any length are encoded whole;
repeated rows each give a row; an empty table gives an empty result; other
columns of ``docs`` are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bytebpe import ENCODED, binaries
from .encode import char_blocks
from .session import documents, small_batches
from .vectext import IdCache, Spans, ragged

MARK = "▁"
#: Fixed value: what the library writes for the id of unknown text.
UNKNOWN = " ⁇ "


class Pieces:
    """A model's vocabulary: whether chunks are independent, and the bytes of each id."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        if m.encode("a  b", out_type=str) != m.encode(f"a{MARK}{MARK}b", out_type=str) or not m.encode("a", out_type=str)[0].startswith(MARK):
            raise ValueError("the model must mark every space and the beginning of a text")
        self.apart = MARK in names and not any(MARK in x.lstrip(MARK) for x in names)
        self.mark = m.piece_to_id(MARK)
        out, self.silent, self.marked = [], np.zeros(len(names), bool), np.array([x.startswith(MARK) for x in names])
        for i, x in enumerate(names):
            self.silent[i] = m.is_control(i)
            out.append(b"" if m.is_control(i) else UNKNOWN.encode() if m.is_unknown(i) else bytes([int(x[3:5], 16)]) if m.is_byte(i) else x.replace(MARK, " ").encode())
        self.bytes = np.frombuffer(b"".join(out), np.uint8)
        self.size = np.array([len(x) for x in out], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.table = IdCache()

    def segment(self, spans: Spans, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some chunks in turn, and how many each has; the library puts the first marker itself."""
        texts = [spans.bytes_of(i)[1:].decode() for i in which.tolist()]
        ids = [x if t else [self.mark] for t, x in zip(texts, self.model.encode(texts, num_threads=1))]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for x in ids for i in x), np.uint32, int(counts.sum())), counts

    def ids_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn, with begin and end, and how many each has."""
        raw = [f" {t}".replace(MARK, " ").encode() if t else b"" for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        offset = np.concatenate(([0], np.cumsum([len(x) for x in raw])))
        edge = np.zeros(len(data), bool)
        if self.apart:
            blank = data == 32
            edge[1:] = blank[1:] & ~blank[:-1]
        edge[offset[:-1][offset[1:] > offset[:-1]]] = True
        start = np.flatnonzero(edge)
        spans = Spans(data, start, np.diff(np.append(start, len(data))))
        ids, counts = self.table.resolve(spans, lambda which: self.segment(spans, which))
        upto = np.concatenate(([0], np.cumsum(counts)))[np.searchsorted(start, offset)]
        n = np.diff(upto) + 2
        end = np.cumsum(n)
        out = np.empty(int(n.sum()), np.uint32)
        out[end - n], out[end - 1] = self.model.bos_id(), self.model.eos_id()
        out[ragged(end - n + 1, n - 2)] = ids
        return out, n

    def decode(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 of each run of ids, and how many bytes each has.  Of bytes that make no text the library decides."""
        if len(ids) and int(ids.max()) >= len(self.size):
            raise ValueError("an id that the model lacks")
        ids = ids.astype(np.int64)
        data, wide = self.bytes[ragged(self.begin[ids], self.size[ids])], np.concatenate(([0], np.cumsum(self.size[ids])))
        upto = np.concatenate(([0], np.cumsum(n)))
        begin, end = wide[upto[:-1]].copy(), wide[upto[1:]]
        heard = np.flatnonzero(~self.silent[ids])
        if len(heard):  # the first marker stands for no space
            at = heard[np.minimum(np.searchsorted(heard, upto[:-1]), len(heard) - 1)]
            begin += (at >= upto[:-1]) & (at < upto[1:]) & self.marked[ids[at]]
        data = data[ragged(begin, end - begin)]
        size = end - begin
        try:
            str(data, "utf-8")
            return data, size
        except UnicodeDecodeError:
            own = [self.model.decode(ids[a:b].tolist()).encode() for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())]
            return np.frombuffer(b"".join(own), np.uint8), np.array([len(x) for x in own], np.int64)


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, the ids as little-endian unsigned 32-bit integers, and the UTF-8 of the text they decode to."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for batch in batches:
            texts, doc = batch.column("text").to_pylist(), batch.column("doc_id")
            for k, part in char_blocks(texts):
                ids, n = own.ids_of(part)
                text, size = own.decode(ids, n)
                upto, wide = np.concatenate(([0], np.cumsum(n))), np.concatenate(([0], np.cumsum(size)))
                columns = [doc.slice(k, len(part)), pa.array(n, pa.int64()), binaries(ids.astype("<u4").view(np.uint8), 4 * upto), binaries(text, wide)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", "decoded"])

    return documents(docs).mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Per row with doc_id and ids: doc_id and the decoded text.

    Null or empty ids decode to an empty text, an id that the model lacks is an
    error; repeated rows each give a row, an empty table none, and other columns
    are not read.
    """
    small_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for batch in batches:
            ids = [np.frombuffer(x or b"", "<u4") for x in batch.column("ids").to_pylist()]
            text = [own.decode(x, np.array([len(x)]))[0].tobytes().decode() for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded string")
