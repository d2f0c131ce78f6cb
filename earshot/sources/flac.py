"""A FLAC encoder for mono samples, and the container bytes of WAV.

Blocks are predicted by one of the fixed polynomials, the one with the smallest
residuals, and these are written as Rice codes in partitions; a block that this
doesn't shorten is written as it is.  A block's codes are placed by cumulative
lengths and set bit by bit in numpy, not sample by sample.
"""

from __future__ import annotations

import struct
from functools import cache

import numpy as np

BLOCK = 4096
#: Samples of a partition with a Rice parameter of its own.
PART = 256
#: Longest unary part of a code; a partition that needs more makes its block verbatim.
_UNARY = 512


@cache
def _table(width: int, poly: int) -> tuple[int, ...]:
    """Remainders of all bytes by a polynomial, most significant bit first."""
    out = []
    for b in range(256):
        c = b << (width - 8)
        for _ in range(8):
            c = (c << 1) ^ (poly if c >> (width - 1) else 0)
            c &= (1 << width) - 1
        out.append(c)
    return tuple(out)


def crc8(data: bytes) -> int:
    table, c = _table(8, 0x07), 0
    for b in data:
        c = table[c ^ b]
    return c


def crc16(data: bytes) -> int:
    table, c = _table(16, 0x8005), 0
    for b in data:
        c = ((c << 8) & 0xFFFF) ^ table[(c >> 8) ^ b]
    return c


class Bits:
    """Fields of bits, packed at the end."""

    def __init__(self) -> None:
        self.parts: list[np.ndarray] = []

    def put(self, values: np.ndarray | int, width: int) -> None:
        """Each value in ``width`` bits, two's complement."""
        v = np.atleast_1d(np.asarray(values, np.int64))
        self.parts.append(((v[:, None] >> np.arange(width - 1, -1, -1)) & 1).astype(np.uint8).ravel())

    def rice(self, folded: np.ndarray, k: int) -> None:
        """Rice codes: the high part as zeros and a one, then k low bits."""
        high = folded >> k
        size = high + 1 + k
        end = np.cumsum(size)
        out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
        one = end - k - 1
        out[one] = 1
        for j in range(k):
            out[one + 1 + j] = (folded >> (k - 1 - j)) & 1
        self.parts.append(out)

    def bytes(self) -> bytes:
        return np.packbits(np.concatenate(self.parts)).tobytes()


def _utf8(n: int) -> bytes:
    """A frame's number, in the form that UTF-8 has beyond Unicode too."""
    if n < 0x80:
        return bytes([n])
    more = 1
    while n >= 1 << (6 * more + 6 - more):
        more += 1
    lead = (0xFF00 >> (more + 1)) & 0xFF
    return bytes([lead | n >> 6 * more, *[0x80 | (n >> 6 * k) & 0x3F for k in range(more - 1, -1, -1)]])


def _subframe(x: np.ndarray, bits: int) -> Bits:
    out = Bits()
    if len(x) and (x == x[0]).all():
        out.put(0, 8)
        out.put(x[:1], bits)
        return out
    verbatim = len(x) * bits
    residuals = [np.diff(x, n) for n in range(min(5, len(x)))]
    order = min(range(len(residuals)), key=lambda n: int(np.abs(residuals[n]).sum()))
    r = residuals[order]
    folded = np.where(r >= 0, 2 * r, -2 * r - 1)
    depth = (len(x) // PART).bit_length() - 1 if len(x) % PART == 0 and (len(x) // PART) & (len(x) // PART - 1) == 0 else 0
    per = len(x) >> depth
    code, begin, size = Bits(), 0, 0
    for part in range(1 << depth):
        some = folded[begin : begin + per - (order if part == 0 else 0)]
        begin += len(some)
        mean = int(some.mean()) if len(some) else 0
        k = min(max(mean.bit_length() - 1, 0), 14)
        if len(some) and int(some.max()) >> k > _UNARY:
            size = verbatim
            break
        code.put(k, 4)
        code.rice(some, k)
        size += 4 + int((some >> k).sum()) + len(some) * (1 + k)
    if order * bits + size + 6 >= verbatim:
        out.put(1 << 1, 8)
        out.put(x, bits)
        return out
    out.put((8 + order) << 1, 8)
    out.put(x[:order], bits)
    out.put(0, 2)
    out.put(depth, 4)
    out.parts += code.parts
    return out


def frame(x: np.ndarray, number: int, bits: int = 16) -> bytes:
    """One frame of up to BLOCK integer samples."""
    head = b"\xff\xf8" + bytes([0x70, 0x00]) + _utf8(number) + struct.pack(">H", len(x) - 1)
    body = head + bytes([crc8(head)]) + _subframe(np.asarray(x, np.int64), bits).bytes()
    return body + struct.pack(">H", crc16(body))


def header(samples: int, rate: int = 48_000, bits: int = 16) -> bytes:
    """The mark and the only block of metadata; the checksum of the samples is left open, as the format allows."""
    word = rate << 44 | 0 << 41 | (bits - 1) << 36 | samples
    return b"fLaC" + bytes([0x80, 0, 0, 34]) + struct.pack(">HH", BLOCK, BLOCK) + bytes(6) + struct.pack(">Q", word) + bytes(16)


def wav_header(samples: int, rate: int = 48_000, bits: int = 16) -> bytes:
    size = samples * bits // 8
    return b"RIFF" + struct.pack("<I", 36 + size) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * bits // 8, bits // 8, bits) + b"data" + struct.pack("<I", size)


class Encoder:
    """Samples in parts of any length to frames of whole blocks; ``end`` gives what is left."""

    def __init__(self, bits: int = 16) -> None:
        self.bits, self.number, self.rest = bits, 0, np.zeros(0, np.int64)

    def add(self, x: np.ndarray, end: bool = False) -> bytes:
        x, out, k = np.concatenate((self.rest, np.asarray(x, np.int64))), [], 0
        while len(x) - k >= BLOCK or (end and k < len(x)):
            out.append(frame(x[k : k + BLOCK], self.number, self.bits))
            self.number += 1
            k += BLOCK
        self.rest = x[k:]
        return b"".join(out)
