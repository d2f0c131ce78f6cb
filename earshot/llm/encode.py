"""Whole texts to ids, for the byte-level rank files and the word-level JSON files."""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np

from . import bpe, pretok
from .vectext import Spans

CHARS = 1 << 19
#: Between ASCII words every pattern here ends a piece, and neither NFC nor lower case reaches across.
CUT = re.compile("(?<=[A-Za-z])(?= [A-Za-z])")


def char_blocks(texts: list[str], limit: int = CHARS) -> Iterator[tuple[int, list[str]]]:
    """Runs of whole texts of at most ``limit`` characters, one text at least, with the number of the first."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > limit:
            yield begin, texts[begin:i]
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, texts[begin:]


@cache
def rank_library(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@cache
def word_library(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def special_strings(path: str) -> tuple[str, ...]:
    import json

    with open(path, encoding="utf-8") as f:
        return tuple(x["content"] for x in json.load(f)["added_tokens"])


def cut(text: str, spaced: bool, path: str) -> list[str]:
    """Parts of a text that are encoded apart; one with special strings stays whole."""
    return [text] if not spaced and any(s in text for s in special_strings(path)) else CUT.split(text)


class Block:
    """Pieces of a block of texts: bounds, UTF-8 bytes, the first piece of each text; ``odd`` texts are for the library."""

    def __init__(self, texts: list[str], spaced: bool, path: str) -> None:
        odd = np.zeros(len(texts), bool)
        if not spaced:
            special = special_strings(path)
            odd[:] = [any(s in t for s in special) or not (t.isascii() or unicodedata.is_normalized("NFC", t)) for t in texts]
        data, offset = pretok.code_points(texts)
        strange = pretok.classes()[data] == pretok.ODD
        if not spaced:
            low = pretok.lower()[data]
            strange |= low > 0x10FFFF
        if strange.any():
            odd[np.searchsorted(offset, np.flatnonzero(strange), side="right") - 1] = True
        if odd.any():
            texts = ["" if o else t for t, o in zip(texts, odd)]
            data, offset = pretok.code_points(texts)
            low = None if spaced else pretok.lower()[data]
        if not spaced:
            data = low.astype(np.uint32)
        self.odd = np.flatnonzero(odd)
        self.data, self.offset = data, offset
        self.start, self.end = pretok.pieces(data, offset, spaced)
        self.first = np.searchsorted(self.start, offset)
        if int(data.max(initial=0)) < 0x80:
            raw, begin, end = data.astype(np.uint8), self.start, self.end
        else:
            upto = np.zeros(len(data) + 1, np.int64)
            np.cumsum(1 + (data > 0x7F) + (data > 0x7FF).view(np.uint8) + (data > 0xFFFF), out=upto[1:])
            raw, begin, end = np.frombuffer(data.tobytes().decode("utf-32-le").encode(), np.uint8), upto[self.start], upto[self.end]
        self.spans = Spans(raw, begin, end - begin)

    def raw(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """UTF-8 bytes of the block, and where some pieces begin in them and how long they are."""
        return self.spans.raw, self.spans.begin[which], self.spans.size[which]


def ids_of(texts: list[str], path: str, pattern: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in turn, and how many each has; pattern: that of a rank file, None for a JSON vocabulary."""
    spaced = pattern is not None
    vocabulary = bpe.rank_file(path) if spaced else bpe.merge_file(path)
    block = Block(texts, spaced, path)
    ids, counts = bpe.cached_ids(path).resolve(block.spans, lambda which: vocabulary.encode(*block.raw(which)))
    upto = np.concatenate(([0], np.cumsum(counts)))[block.first]
    n = np.diff(upto)
    if len(block.odd):
        own = []
        for i in block.odd.tolist():
            if len(parts := cut(texts[i], spaced, path)) > 1:
                own.append(ids_of(parts, path, pattern)[0])
            elif spaced:
                own.append(rank_library(path, pattern).encode_ordinary(texts[i]))
            else:
                own.append(word_library(path).encode(texts[i], add_special_tokens=False).ids)
        parts = np.split(ids, upto[1:-1])
        for i, x in zip(block.odd.tolist(), own):
            parts[i] = np.array(x, np.uint32)
            n[i] = len(x)
        ids = np.concatenate(parts)
    return ids, n


__all__ = ["Block", "char_blocks", "ids_of", "rank_library", "word_library"]
