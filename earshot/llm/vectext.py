"""Vectorised text primitives in numpy, shared by the operators of this subpackage.

A block is a run of whole documents, at most ``BLOCK`` bytes unless one
document alone is longer, so the memory of a worker is bounded by the longest
document rather than by the Arrow batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np

BLOCK = 1 << 20
U64 = np.uint64

_GOLD = 0x9E3779B97F4A7C15
#: One random odd value for each byte, and the base of the rolling hash.
BYTE_VALUE = np.random.default_rng(20240229).integers(1, 2**64, 256, dtype=np.uint64) | U64(1)
_BASE, _INVERSE = _GOLD, pow(_GOLD, -1, 1 << 64)
#: Space, tab, newline, vertical tab, form feed, carriage return.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    h = (h ^ (h >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def blocks(texts: Iterable[bytes], limit: int = BLOCK) -> Iterator[list[bytes]]:
    """Whole documents in runs of at most ``limit`` bytes, one at least."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > limit:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t) + 1
    if held:
        yield held


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, BLOCK + 4096)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, base, U64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=U64)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums so that the rolling hash of data[s:e] is (P[e] - P[s]) * base**-s; for windows of some dozens of bytes only."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_VALUE[data] * up[:-1], dtype=U64, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U64))


class Spans:
    """Byte strings data[begin : begin + size] of one array, read eight bytes at a time.

    Their hashes pass every eight bytes through a mixing step, so no two texts
    are known to share one; a polynomial modulo a power of two has such pairs.
    """

    #: Longer strings are hashed one by one.
    SHORT = 128
    _MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)

    def __init__(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        self.raw = np.concatenate((data, np.zeros(8, np.uint8)))
        self.view = np.ndarray(len(data) + 1, "<u8", self.raw, strides=(1,))
        self.begin, self.size = begin, size

    def word(self, which: np.ndarray, k: int) -> np.ndarray:
        """Bytes 8k to 8k + 8 of some of the strings, zero beyond their ends."""
        return self.view[self.begin[which] + 8 * k] & self._MASK[np.minimum(self.size[which] - 8 * k, 8)]

    def bytes_of(self, i: int) -> bytes:
        return self.raw[self.begin[i] : self.begin[i] + self.size[i]].tobytes()

    def hashes(self, seed: int = 0) -> np.ndarray:
        """64-bit hashes; other seeds give independent ones."""
        h = mix(self.size.astype(U64) + U64((seed * _GOLD + 1) % (1 << 64)))
        long_ = np.flatnonzero(self.size > self.SHORT)
        for i in long_.tolist():
            h[i] = int.from_bytes(hashlib.blake2b(self.bytes_of(i), digest_size=8, key=b"%d" % seed).digest(), "little")
        live, k = np.flatnonzero((self.size > 0) & (self.size <= self.SHORT)), 0
        while len(live):
            h[live] = mix((h[live] ^ self.word(live, k)) + U64(_GOLD))
            k += 1
            live = live[self.size[live] > 8 * k]
        return h


class Words:
    """Maximal runs of bytes other than ASCII white space in a block of documents.

    ``start``/``end`` point into ``data``; ``first`` has, for each document and
    one past the last, the index of its first word.
    """

    def __init__(self, block: list[bytes], lower: bool = False) -> None:
        self.raw = b"\n".join(block) + b"\n"
        data = np.frombuffer(self.raw, np.uint8)
        self.data = LOWER[data] if lower else data
        sizes = np.fromiter(map(len, block), np.int64, len(block)) + 1
        self.offset = np.concatenate(([0], np.cumsum(sizes)))
        space = IS_SPACE[self.data]
        edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=np.int8(1)))
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.offset)

    def hashes(self, seed: int = 0) -> np.ndarray:
        return Spans(self.data, self.start, self.end - self.start).hashes(seed)


class IdCache:
    """Open-addressing table from short byte strings to runs of ids, in numpy arrays.

    A string is found by its hash and then compared byte by byte.  The table
    holds at most ``most`` strings in some sixty bytes each and starts anew
    beyond that, so its memory is bounded whatever the vocabulary of the text.
    Long strings, and those whose hash another one has, are encoded each time.
    """

    def __init__(self, most: int = 1_000_000) -> None:
        self.most = most
        self.reset()

    def reset(self, slots: int = 1 << 18) -> None:
        self.key = np.zeros(slots, U64)
        self.slot = np.full(slots, -1, np.int32)
        self.n = 0
        some = 1 << 16
        self.hash, self.size = np.zeros(some, U64), np.zeros(some, np.int32)
        self.begin, self.first = np.zeros(some + 1, np.int64), np.zeros(some + 1, np.int64)
        self.pool, self.words = np.zeros(4 * some, np.uint32), np.zeros(2 * some, U64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the strings with these hashes, -1 where unknown."""
        mask = len(self.key) - 1
        at = (h & U64(mask)).astype(np.int64)
        out = self.slot[at]
        wrong = np.flatnonzero((out >= 0) & (self.key[at] != h))
        at = at[wrong]
        while len(wrong):
            at = (at + 1) & mask
            got = self.slot[at]
            out[wrong] = got
            keep = (got >= 0) & (self.key[at] != h[wrong])
            wrong, at = wrong[keep], at[keep]
        return out

    def _equal(self, number: np.ndarray, spans: Spans) -> np.ndarray:
        """Whether each string is the one that the table holds under its number."""
        known = np.maximum(number, 0)
        ok = (number >= 0) & (self.size[known] == spans.size)
        live, k = np.flatnonzero(ok), 0
        while len(live := live[spans.size[live] > 8 * k]):
            good = self.words[self.first[known[live]] + k] == spans.word(live, k)
            ok[live[~good]] = False
            live, k = live[good], k + 1
        return ok

    def _place(self, h: np.ndarray, number: np.ndarray) -> None:
        """Put distinct unknown hashes into the table; of several that want a slot, one a round gets it."""
        mask = len(self.key) - 1
        at = (h & U64(mask)).astype(np.int64)
        while len(h):
            free = self.slot[at] < 0
            won = np.zeros(len(h), bool)
            f = np.flatnonzero(free)
            self.slot[at[f]] = number[f]
            won[f] = self.slot[at[f]] == number[f]
            w = np.flatnonzero(won)
            self.key[at[w]] = h[w]
            lost = ~won
            h, number, at = h[lost], number[lost], (at[lost] + 1) & mask

    def _add(self, h: np.ndarray, spans: Spans, which: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Strings with distinct unknown hashes and their ids, concatenated."""
        n = self.n + len(h)
        if n > 0.6 * len(self.key):
            slots = len(self.key)
            while n > 0.3 * slots:
                slots *= 2
            self.key, self.slot = np.zeros(slots, U64), np.full(slots, -1, np.int32)
            self._place(self.hash[: self.n], np.arange(self.n, dtype=np.int32))
        if n > len(self.hash):
            self.hash, self.size = np.resize(self.hash, 2 * n), np.resize(self.size, 2 * n)
            self.begin, self.first = np.resize(self.begin, 2 * n + 1), np.resize(self.first, 2 * n + 1)
        new = slice(self.n, n)
        self.hash[new], self.size[new] = h, spans.size[which]
        words = -(-spans.size[which] // 8)
        for bounds, many in ((self.begin, counts), (self.first, words)):
            bounds[self.n + 1 : n + 1] = bounds[self.n] + np.cumsum(many)
        if self.begin[n] > len(self.pool):
            self.pool = np.resize(self.pool, 2 * self.begin[n])
        if self.first[n] > len(self.words):
            self.words = np.resize(self.words, 2 * self.first[n])
        self.pool[self.begin[self.n] : self.begin[n]] = ids
        for k in range(int(words.max(initial=0))):
            w = np.flatnonzero(words > k)
            self.words[self.first[self.n + w] + k] = spans.word(which[w], k)
        self._place(h, np.arange(self.n, n, dtype=np.int32))
        self.n = n

    def resolve(self, spans: Spans, encode: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all strings in turn, and how many each has; ``encode`` gives both for some of the strings."""
        h = spans.hashes()
        short = spans.size <= Spans.SHORT
        number = np.where(short, self.find(h), -1)
        if len(unknown := np.flatnonzero(short & (number < 0))):
            new = unknown[np.unique(h[unknown], return_index=True)[1]]
            if self.n and self.n + len(new) > self.most:
                self.reset()
                return self.resolve(spans, encode)
            self._add(h[new], spans, new, *encode(new))
            number[unknown] = self.find(h[unknown])
        good = self._equal(number, spans)
        number = np.maximum(number, 0)
        begin, counts = self.begin[number], np.where(good, self.begin[number + 1] - self.begin[number], 0)
        if good.all():
            return self.pool[ragged(begin, counts)], counts
        rest = np.flatnonzero(~good)
        own, many = encode(rest)
        known = self.pool[ragged(begin, counts)]
        counts[rest] = many
        out, is_known = np.empty(len(known) + len(own), np.uint32), np.repeat(good, counts)
        out[is_known], out[~is_known] = known, own
        return out, counts


def ragged(begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices begin[i], begin[i]+1, ... for counts[i] places, one run after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = begin - np.concatenate(([0], np.cumsum(counts)[:-1]))
    return np.arange(total, dtype=np.int64) + np.repeat(shift, counts)
