"""Byte-pair encoding of many pieces at once, by a segment tree over byte positions.

Each piece has a tree whose leaves hold, for every live position, the rank of
the pair that begins there; a node holds the smallest rank below it and, of
equal ranks, the leftmost position.  The root names the next merge, and a merge
changes three leaves: its own, that of the position it swallows and that of its
left neighbour.  The trees of all pieces of a like length are rows of one numpy
array, so one step merges one pair in each of thousands of pieces.

A long piece is encoded in parts that overlap.  Which tokens a text has is
decided between neighbours alone: a row of tokens of which any two neighbours
are the encoding of their own bytes is the encoding of the whole.  So two parts
join at any token that both have in the same place; parts without one are
encoded again as one part.
"""

from __future__ import annotations

import base64
import json
from functools import cache

import numpy as np

from .vectext import U64, IdCache, mix, ragged

_NONE = np.int32(2**31 - 1)
_CELLS = 1 << 19
#: Widest piece whose rank and position fit in 32 bits.
_NARROW = 1 << 14
#: Widest part of a long piece and bytes from one part to the next, in turn: most pieces join at the
#: first pair, repeats of any short period keep step with the second, and the last is a piece at once.
_PARTS = ((512, 288), (2048, 1440), (1 << 40, 1 << 40))


class PairTable:
    """Hash table from a pair of ids to the id, which is also the rank, of the pair joined."""

    def __init__(self, left: np.ndarray, right: np.ndarray, joined: np.ndarray) -> None:
        key = (left.astype(U64) << U64(32)) | right.astype(U64)
        slots = 1 << (4 * len(key)).bit_length()
        self.mask = slots - 1
        self.key, self.value = np.zeros(slots, U64), np.full(slots, -1, np.int32)
        at = (mix(key) & U64(self.mask)).astype(np.int64)
        n = np.arange(len(key))
        while len(n):
            free = np.flatnonzero(self.value[at] < 0)
            _, one = np.unique(at[free], return_index=True)
            w = free[one]
            self.key[at[w]], self.value[at[w]] = key[n[w]], joined[n[w]]
            lost = np.ones(len(n), bool)
            lost[w] = False
            n, at = n[lost], (at[lost] + 1) & self.mask

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the joined pairs, -1 where there is none."""
        key = (left.astype(U64) << U64(32)) | right.astype(U64)
        at = (mix(key) & U64(self.mask)).astype(np.int64)
        out = self.value[at]
        wrong = np.flatnonzero((out >= 0) & (self.key[at] != key))
        at = at[wrong]
        while len(wrong):
            at = (at + 1) & self.mask
            got = self.value[at]
            out[wrong] = got
            keep = (got >= 0) & (self.key[at] != key[wrong])
            wrong, at = wrong[keep], at[keep]
        return out


class Vocabulary:
    """Token bytes by id, the id of each byte, of a byte that ends a word, and the pairs that merge."""

    def __init__(self, tokens: list[bytes], first: np.ndarray, final: np.ndarray, pairs: np.ndarray, ranks: bool) -> None:
        self.tokens, self.first, self.final = tokens, first, final
        self.ranks, self.apart = ranks or None, None
        self.pair_ids = pairs
        self.pairs = PairTable(*pairs.T)
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.begin = np.concatenate(([0], np.cumsum(self.size)))[:-1]
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids, one after the other."""
        return self.bytes[ragged(self.begin[ids], self.size[ids])]

    def encode(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces data[begin : begin + size] in turn, and how many each has."""
        n = len(begin)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        out_ids: list[np.ndarray] = []
        count, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
        at, todo = 0, np.arange(n)
        if self.apart is None and self.ranks is not None:
            self.apart = self._apart()
        if self.apart:
            known = np.array([self.apart.get(data[b : b + k].tobytes(), -1) for b, k in zip(begin.tolist(), size.tolist())])
            hit = np.flatnonzero(known >= 0)
            out_ids.append(known[hit].astype(np.uint32))
            count[hit], place[hit] = 1, np.arange(len(hit))
            at, todo = len(hit), np.flatnonzero(known < 0)
        for k in todo[size[todo] > _PARTS[0][0]].tolist():
            ids = self._long(data, int(begin[k]), int(size[k]), True, 0)
            out_ids.append(ids)
            count[k], place[k] = len(ids), at
            at += len(ids)
        todo = todo[size[todo] <= _PARTS[0][0]]
        parts, ids, many = self._rows(data, begin[todo], size[todo], np.ones(len(todo), bool))
        count[todo[parts]] = many
        place[todo[parts]] = at + np.cumsum(many) - many
        out_ids.append(ids)
        return np.concatenate(out_ids)[ragged(place, count)], count

    def _rows(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, closed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order of the pieces, their ids in that order, and how many each has; ``closed``: the last byte ends a word."""
        order, out_ids, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        width = 1 << np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64)
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            step = max(1, _CELLS // int(w))
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                ids, many = self._merge(data, begin[part], size[part], closed[part], int(w))
                order.append(part)
                out_ids.append(ids)
                counts.append(many)
        return np.concatenate(order), np.concatenate(out_ids), np.concatenate(counts)

    def _long(self, data: np.ndarray, begin: int, size: int, closed: bool, level: int) -> np.ndarray:
        """Ids of one long piece, from parts that overlap."""
        whole, step = _PARTS[level]
        if size <= whole:
            return self._rows(data, np.array([begin]), np.array([size]), np.array([closed]))[1]
        low = np.arange(0, size - (whole - step), step)
        high = np.minimum(low + whole, size)
        order, ids, many = self._rows(data, begin + low, high - low, (high == size) & closed)
        parts: list[tuple] = [(a, b, None) for a, b in zip(low.tolist(), high.tolist())]
        found = list(zip(order.tolist(), np.split(ids, np.cumsum(many)[:-1])))
        while True:
            for k, x in found:
                at = parts[k][0] + np.cumsum(self.size[x]) - self.size[x]
                parts[k] = (*parts[k][:2], (x.astype(np.int64), at))
            # Where each part hands over to the next: the first token that both have in the same place.
            cuts = []
            for (_, _, (x, at)), (_, _, (y, bt)) in zip(parts, parts[1:]):
                same = np.intersect1d(at << 32 | x, bt << 32 | y)
                cuts.append(int(same[0]) >> 32 if len(same) else -1)
            if all(c >= 0 for c in cuts):
                break
            joined: list[tuple] = []
            for part, cut in zip(parts, [0, *cuts]):
                if cut < 0:
                    joined[-1] = (joined[-1][0], part[1], None)
                else:
                    joined.append(part)
            parts = joined
            found = [(k, self._long(data, begin + a, b - a, closed and b == size, level + 1)) for k, (a, b, x) in enumerate(parts) if x is None]
        edges = zip([0, *cuts], [*cuts, size])
        return np.concatenate([x[(at >= a) & (at < b)] for (_, _, (x, at)), (a, b) in zip(parts, edges)]).astype(np.uint32)

    def _apart(self) -> dict[bytes, int]:
        """Tokens that merging alone doesn't make from their bytes; a piece that equals one of them is that token."""
        self.apart = {}
        ids, many = self.encode(self.bytes, self.begin, self.size)
        own = np.flatnonzero((many == 1) & (self.size > 0))
        upto = np.cumsum(many) - many
        same = np.zeros(len(many), bool)
        same[own] = ids[upto[own]] == own
        return {self.tokens[k]: k for k in np.flatnonzero(~same & (self.size > 0)).tolist()}

    def _merge(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, closed: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(begin)
        col = np.arange(w)
        inside = col[None, :] < size[:, None]
        ids = np.full((n, w + 1), -1, np.int32)
        flat = data[ragged(begin, size)]
        ids[:, :w][inside] = self.first[flat]
        full = np.flatnonzero((size > 0) & closed)
        ids[full, size[full] - 1] = self.final[data[begin[full] + size[full] - 1]]
        after = np.broadcast_to(np.minimum(col + 1, w), (n, w)).copy()
        after = np.where(after >= size[:, None], w, after)
        before = np.broadcast_to(col - 1, (n, w)).copy()
        kind = np.int32 if w <= _NARROW else np.int64
        none = kind(_NONE if w <= _NARROW else 2**62)
        tree = np.full((n, 2 * w), none, kind)
        r, c = np.nonzero(inside[:, : w - 1] & inside[:, 1:])
        rank = self.pairs.find(ids[r, c], ids[r, c + 1])
        got = rank >= 0
        tree[r[got], w + c[got]] = rank[got].astype(np.int64) * w + c[got]  # below 2**31 for narrow pieces
        level = w
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        rows = np.flatnonzero(tree[:, 1] < none)
        while len(rows):
            root = tree[rows, 1].astype(np.int64)
            pos, rank = root & (w - 1), root // w
            right = after[rows, pos]
            following = after[rows, right]
            ids[rows, pos], ids[rows, right] = rank, -1
            after[rows, pos] = following
            tree[rows, w + right] = none
            has = following < w
            before[rows[has], following[has]] = pos[has]
            leaf = np.full(len(rows), none, kind)
            got = np.full(len(rows), -1, np.int64)
            got[has] = self.pairs.find(rank[has], ids[rows[has], following[has]])
            ok = got >= 0
            leaf[ok] = got[ok] * w + pos[ok]
            tree[rows, w + pos] = leaf
            prior = before[rows, pos]
            p = np.flatnonzero(prior >= 0)
            leaf = np.full(len(p), none, kind)
            got = self.pairs.find(ids[rows[p], prior[p]], rank[p]).astype(np.int64)
            ok = got >= 0
            leaf[ok] = got[ok] * w + prior[p][ok]
            tree[rows[p], w + prior[p]] = leaf
            a, b, d = w + pos, w + right, w + prior[p]
            q = rows[p]
            while a[0] > 1:
                tree[rows, a >> 1] = np.minimum(tree[rows, a], tree[rows, a ^ 1])
                tree[rows, b >> 1] = np.minimum(tree[rows, b], tree[rows, b ^ 1])
                tree[q, d >> 1] = np.minimum(tree[q, d], tree[q, d ^ 1])
                a, b, d = a >> 1, b >> 1, d >> 1
            rows = rows[tree[rows, 1] < none]
        ids = ids[:, :w]
        alive = ids >= 0
        return ids[alive].astype(np.uint32), alive.sum(axis=1)


@cache
def rank_file(path: str) -> Vocabulary:
    """A vocabulary of ranks, one base64 token and its rank on each line; any two tokens whose bytes join to a token merge."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    tokens = [b""] * (max(ranks.values()) + 1)
    pairs = []
    for t, k in ranks.items():
        tokens[k] = t
        for i in range(1, len(t)):
            if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None:
                pairs.append((a, b, k))
    first = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
    return Vocabulary(tokens, first, first, np.array(pairs, np.int64), True)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where Latin-1 prints it, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(extra)
            extra += 1
    return [letters[b] for b in range(256)]


@cache
def merge_file(path: str) -> Vocabulary:
    """A JSON vocabulary of listed merges with word ends; ids must follow the order of the merges."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, end = model["vocab"], model["end_of_word_suffix"]
    letters = byte_letters()
    value = {c: bytes([b]) for b, c in enumerate(letters)}
    tokens = [b""] * (max(vocab.values()) + 1)
    for t, k in vocab.items():
        tokens[k] = b"".join(value.get(c, b"") for c in t.removesuffix(end))
    pairs = []
    for m in model["merges"]:
        a, b = m.split(" ") if isinstance(m, str) else m
        pairs.append((vocab[a], vocab[b], vocab[a + b]))
    pairs = np.array(pairs, np.int64)
    assert (np.diff(pairs[:, 2]) > 0).all(), "the ids of merged tokens must follow the order of the merges"
    first = np.array([vocab[c] for c in letters], np.int32)
    final = np.array([vocab[c + end] for c in letters], np.int32)
    return Vocabulary(tokens, first, final, pairs, False)


@cache
def cached_ids(path: str) -> IdCache:
    """One cache of encoded pieces for each vocabulary and Python worker."""
    return IdCache()
