"""Vectorised pre-tokenisation over code points.

Both families of tokenizers split a text into pieces by the classes letter,
number, white space and other; the pieces are encoded apart.  Here a block of
texts becomes one array of code points and the pieces become two arrays of
bounds.  Texts with code points whose class
differs between Unicode versions are left to the library itself.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import numpy as np

LETTER, NUMBER, SPACE, OTHER, ODD = range(5)
#: The code points of Unicode's White_Space property.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_LIMIT = 0x110000


@cache
def classes() -> np.ndarray:
    """Class by code point; those assigned after Unicode 3.2 (save U+1F300 to U+1F64F), or not at all, and surrogates are ODD."""
    out = np.full(_LIMIT, OTHER, np.uint8)
    old = unicodedata.ucd_3_2_0
    for c in range(_LIMIT):
        kind = unicodedata.category(chr(c))
        if kind == "Cn" or (c > 0x2FF and old.category(chr(c)) == "Cn" and not 0x1F300 <= c < 0x1F650):
            out[c] = ODD
        elif kind[0] == "L":
            out[c] = LETTER
        elif kind[0] == "N":
            out[c] = NUMBER
        if 0xD800 <= c < 0xE000:
            out[c] = ODD
    out[WHITE] = SPACE
    return out


@cache
def lower() -> np.ndarray:
    """Lower case by code point; those with another rule or more than one result get the limit."""
    out = np.arange(_LIMIT, dtype=np.uint32)
    for c in range(_LIMIT):
        if (low := chr(c).lower()) != chr(c):
            out[c] = ord(low) if len(low) == 1 else sys.maxunicode + 1
    out[0x3A3] = sys.maxunicode + 1  # final sigma depends on what follows
    return out


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, a newline after each, and where each text begins."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    data = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    return data, np.concatenate(([0], np.cumsum(sizes)))


def pieces(data: np.ndarray, offset: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the pieces, in order.

    spaced: a space goes with the run after it, runs of numbers and of white
    space are pieces (the byte-level pattern).  Otherwise white space separates
    and each number is a piece (the word-level pattern).  In both an apostrophe
    that begins a piece takes s, t, m, d, re, ve or ll with it.
    """
    kind = classes()[data]
    kind[offset[1:] - 1] = ODD  # the newlines between the texts belong to none
    edge = np.empty(len(data), bool)
    edge[0] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:])
    if not spaced:
        edge |= kind == NUMBER
    edge[offset[1:-1]] = True
    edge[offset[1:] - 1] = True
    start = np.flatnonzero(edge)
    end = np.append(start[1:], len(data))
    is_space = kind[start] == SPACE
    real = kind[start] != ODD
    if spaced:
        last = np.flatnonzero(is_space[:-1] & real[1:])  # white space before something in the same text
        blank = data[end[last] - 1] == 32
        attach = last[blank]
        start[attach + 1] -= 1
        end[attach] -= 1
        cut = last[~blank & (end[last] - start[last] > 1)]
        extra = end[cut] - 1
        end[cut] -= 1
        more = (extra, extra + 1)
        keep = real & (end > start)
    else:
        more = None
        keep = real & ~is_space
    single = np.flatnonzero(keep[:-1] & keep[1:] & (end[:-1] - start[:-1] == 1) & (data[start[:-1]] == 39) & (kind[start[1:]] == LETTER) & (end[:-1] == start[1:]))
    if len(single):
        a = data[start[single] + 1]
        two = end[single + 1] - start[single + 1] > 1
        b = np.where(two, data[np.minimum(start[single] + 2, len(data) - 1)], 0)
        takes = np.where(np.isin(a, [ord(x) for x in "stmd"]), 1, 0)
        takes[((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))] = 2
        end[single] += takes
        start[single + 1] += takes
        keep &= end > start
    start, end = start[keep], end[keep]
    if more is not None and len(more[0]):
        order = np.argsort(np.concatenate((start, more[0])), kind="stable")
        start, end = np.concatenate((start, more[0]))[order], np.concatenate((end, more[1]))[order]
    return start, end
