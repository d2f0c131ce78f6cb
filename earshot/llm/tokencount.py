"""Token counts by dynamic programming over prefixes, for a word-level JSON vocabulary.

For every prefix of a piece the last token of its encoding is unique: it is the
one suffix token that may follow the last token of the shorter prefix.  Whether
one token may follow another is decided by undoing their merges across the
border.  So the count at a prefix is one more than at a shorter prefix, and a
table of counts answers truncation and budget questions without encoding again.
Counts come in two kinds: ``inside`` (the piece goes on) and ``closed`` (the
text ends here, so the last token carries the word end).  Short pieces are
rows of one table; on a long one an automaton names the tokens that end at each
place, and the same programme walks along it.

Defined cases: a null or empty text counts 0; texts of any length are counted
whole; texts with special strings, and the parts between ASCII words that aren't
NFC or have a character of class ODD (``pretok.py``) or whose lower case depends on
context or is several characters, are counted by the library itself; repeated rows each give a row; an empty table gives an empty
result; other columns of ``docs`` are not read, so their names can't clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe
from .encode import Block, char_blocks, cut, special_strings, word_library
from .session import documents, small_batches
from .vectext import BYTE_VALUE, U64, IdCache, powers, prefix_hash, ragged

_CELLS = 1 << 20
#: A space ends every piece, and neither NFC nor lower case reaches across it.
_APART = re.compile("(?<=[^ ])(?= )")
#: Longer pieces are walked along one by one.
_ROW = 512
#: Answers of the walk that are remembered.
_KNOWN = 1 << 20
#: Larger blocks than elsewhere: the more unknown pieces meet, the less a step of the tables costs each.
CHARS = 1 << 21


class PrefixCounter:
    """The tables for one vocabulary."""

    def __init__(self, path: str) -> None:
        v = bpe.merge_file(path)
        self.vocabulary = v
        n = len(v.tokens)
        self.left, self.right = np.arange(n), np.arange(n)
        a, b, c = v.pair_ids.T
        self.left[c], self.right[c] = a, b
        ends = np.zeros(n, bool)
        ends[v.final] = True
        for x, y, z in v.pair_ids.tolist():
            ends[z] = ends[y]
        used = np.zeros(n, bool)
        used[v.first] = used[v.final] = used[c] = True
        ids = np.flatnonzero(used)
        self.longest = int(v.size[ids].max())
        p = prefix_hash(v.bytes)
        _, down = powers(len(p))
        h = (p[v.begin + v.size] - p[v.begin]) * down[v.begin]
        inner, final = ids[~ends[ids]], ids[ends[ids]]
        self.kinds = inner.tolist(), final.tolist()
        self.known: dict[int, bool] = {}
        self.inner, self.final = _Spans(h[inner], inner), _Spans(h[final], final)

    def follows(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether encoding the bytes of both tokens gives these two tokens."""
        out = np.ones(len(first), bool)
        at = np.arange(len(first))
        a, b = first.astype(np.int64), second.astype(np.int64)
        limit = np.full(len(first), 2**31 - 1, np.int64)
        while len(at):
            joined = self.vocabulary.pairs.find(a, b)
            bad = (joined >= 0) & (joined < limit)
            out[at[bad]] = False
            at, a, b, limit = (x[~bad] for x in (at, a, b, limit))
            later = a > b  # the younger merge is undone first; where it can't be, the other one
            ra, lb = self.right[a], self.left[b]
            undo_a = (later & (ra != a)) | (~later & (lb == b) & (ra != a))
            undo_b = ~undo_a & (lb != b)
            limit = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, ra, a), np.where(undo_b, lb, b)
            keep = undo_a | undo_b
            at, a, b, limit = (x[keep] for x in (at, a, b, limit))
        return out

    @cached_property
    def automata(self) -> tuple:
        """Automata of the tokens inside a word and of those that end one, and the pairs that merge."""
        import ahocorasick

        out = []
        for kind in self.kinds:
            one = ahocorasick.Automaton()
            for k in kind:
                one.add_word(self.vocabulary.tokens[k].decode("latin-1"), k)
            one.make_automaton()
            out.append(one)
        return *out, {(a << 32) | b: c for a, b, c in self.vocabulary.pair_ids.tolist()}, self.left.tolist(), self.right.tolist()

    def follows_one(self, a: int, b: int) -> bool:
        """``follows`` for one pair."""
        key = (a << 32) | b
        if (known := self.known.get(key)) is not None:
            return known
        if len(self.known) >= _KNOWN:
            self.known.clear()
        _, _, pairs, left, right = self.automata
        limit, good = 1 << 40, True
        while True:
            joined = pairs.get((a << 32) | b)
            if joined is not None and joined < limit:
                good = False
                break
            if right[a] != a and (a > b or left[b] == b):
                limit, a = a, right[a]
            elif left[b] != b:
                limit, b = b + 1, left[b]
            else:
                break
        self.known[key] = good
        return good

    def walk(self, piece: bytes, every: bool) -> tuple[np.ndarray, np.ndarray]:
        """``table`` for one piece of any length."""
        inner, final, *_ = self.automata
        text, n, size = piece.decode("latin-1"), len(piece), self.vocabulary.size.tolist()
        last, inside, closed = [-1] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        follows, done = self.follows_one, -1
        for at, token in inner.iter(text):
            if at != done:
                j = at + 1 - size[token]
                if j == 0 or follows(last[j], token):
                    last[at + 1], inside[at + 1], done = token, inside[j] + 1, at
        done = -1
        from_ = 0 if every else max(0, n - self.longest)
        for at, token in final.iter(text, from_):
            if at != done and (every or at == n - 1):
                j = at + 1 - size[token]
                if j == 0 or follows(last[j], token):
                    closed[at + 1], done = inside[j] + 1, at
        return np.array(inside), np.array(closed)

    def table(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, every: bool) -> tuple[np.ndarray, np.ndarray]:
        """Counts inside and closed at each prefix of pieces data[begin : begin + size]; not ``every``: closed at the end only."""
        n, w = len(begin), int(size.max())
        sums = np.zeros((n, w + 1), U64)
        cell = np.zeros((n, w), np.uint8)
        cell[np.arange(w)[None, :] < size[:, None]] = data[ragged(begin, size)]
        up, down = powers(w + 1)
        np.cumsum(BYTE_VALUE[cell] * up[:-1], axis=1, dtype=U64, out=sums[:, 1:])
        last = np.full((n, w + 1), -1, np.int64)
        inside, closed = np.zeros((n, w + 1), np.int64), np.zeros((n, w + 1), np.int64)
        for i in range(1, w + 1):
            for final in (False, True):
                rows = np.flatnonzero((size >= i) if every else (size == i if final else size > i))
                for k in range(min(i, self.longest), 0, -1):
                    if not len(rows):
                        break
                    j = i - k
                    token = (self.final if final else self.inner).find((sums[rows, i] - sums[rows, j]) * down[j])
                    prior = last[rows, j]
                    hit = np.flatnonzero((token >= 0) & ((prior >= 0) | (j == 0)))
                    if j and len(hit):
                        hit = hit[self.follows(prior[hit], token[hit])]
                    if len(hit):
                        r = rows[hit]
                        if final:
                            closed[r, i] = inside[r, j] + 1
                        else:
                            inside[r, i], last[r, i] = inside[r, j] + 1, token[hit]
                        rows = np.delete(rows, hit)
        return inside, closed

    def counts(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Tokens of whole pieces."""
        out = np.zeros(len(begin), np.int64)
        for k in np.flatnonzero(size > _ROW).tolist():
            out[k] = self.walk(data[begin[k] : begin[k] + size[k]].tobytes(), every=False)[1][-1]
        order = np.flatnonzero(size <= _ROW)
        order = order[np.argsort(size[order], kind="stable")]
        k = 0
        while k < len(order):
            w = int(size[order[k]])
            top = max(8, 1 << (w - 1).bit_length())
            stop = min(k + max(1, _CELLS // (top + 1)), int(np.searchsorted(size[order], top, side="right")))
            part = order[k:stop]
            _, closed = self.table(data, begin[part], size[part], every=False)
            out[part] = closed[np.arange(len(part)), size[part]]
            k = stop
        return out


class _Spans:
    """Token by the hash of its bytes."""

    def __init__(self, h: np.ndarray, ids: np.ndarray) -> None:
        self.table = bpe.PairTable(h >> U64(32), h & U64(0xFFFFFFFF), ids)

    def find(self, h: np.ndarray) -> np.ndarray:
        return self.table.find(h >> U64(32), h & U64(0xFFFFFFFF))


@cache
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


@cache
def cached_counts(path: str) -> IdCache:
    return IdCache()


def count_texts(texts: list[str], path: str) -> np.ndarray:
    """Token counts of whole texts."""
    block = Block(texts, False, path)

    def fresh(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = counter(path).counts(*block.raw(which))
        return n.astype(np.uint32), np.ones(len(n), np.int64)

    n, _ = cached_counts(path).resolve(block.spans, fresh)
    out = np.diff(np.concatenate(([0], np.cumsum(n, dtype=np.int64)))[block.first])
    for i in block.odd.tolist():
        parts = cut(texts[i], False, path)
        out[i] = count_texts(parts, path).sum() if len(parts) > 1 else len(word_library(path).encode(texts[i], add_special_tokens=False).ids)
    return out


def prefix_counts(text: str, path: str) -> np.ndarray:
    """Tokens of text[:k] for k from 0 to its length, from one pass of dynamic programming."""
    block = Block([text], False, path)
    if len(block.odd):
        special = any(" " in x or x in text for x in special_strings(path))
        parts = [text] if special else _APART.split(text)
        if len(parts) > 1:  # nothing reaches across a space, so counts of parts add up
            each = [prefix_counts(p, path) for p in parts]
            before = np.concatenate(([0], np.cumsum([c[-1] for c in each])))
            return np.concatenate([each[0][:1], *[c[1:] + b for c, b in zip(each, before)]])
        return np.array([len(word_library(path).encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)])
    out = np.zeros(len(text) + 1, np.int64)
    raw, begin, size = block.raw(np.arange(len(block.start)))
    done, at = 0, 0
    for s, e, b, k in zip(block.start.tolist(), block.end.tolist(), begin.tolist(), size.tolist()):
        out[at : s + 1] = done
        closed = counter(path).walk(raw[b : b + k].tobytes(), every=True)[1]
        wide = np.cumsum([len(chr(c).encode()) for c in block.data[s:e].tolist()])
        out[s + 1 : e + 1] = done + closed[wide]
        if e - s == 3 and block.data[s] == 39:  # cut before its last letter, the contraction is two pieces
            out[s + 2] = done + 2
        done, at = int(out[e]), e
    out[at:] = done
    return out


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes of the text in UTF-8 and n_tokens."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, doc = batch.column("text").to_pylist(), batch.column("doc_id")
            for k, part in char_blocks(texts, CHARS):
                size = [len(t) if t.isascii() else len(t.encode()) for t in part]
                yield pa.RecordBatch.from_arrays([doc.slice(k, len(part)), pa.array(size, pa.int64()), pa.array(count_texts(part, path), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return documents(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def fit_to_budget(docs: DataFrame, path: str, budget: int) -> DataFrame:
    """Per row: doc_id, and ``kept`` - the longest prefix of the text of at most ``budget`` tokens whose longer prefixes exceed it.

    A null text counts as empty and keeps an empty prefix, as every text does for
    a budget of 0 or less; repeated rows each give a row, an empty table none.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            kept = [t[: int(np.flatnonzero(prefix_counts(t, path) <= max(budget, 0))[-1])] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.string())], names=["doc_id", "kept"])

    return documents(docs).mapInArrow(run, "doc_id long, kept string")
