"""Texts with unusual characters: equal to the library, which sees only the parts around them."""

import random

from earshot.llm import encode, queries, tokencount

ODD = ["₹", "₿", "\U0001f680", "\U0001f914", "ẞ", "é", "ΟΔΟΣ", "İ", "͸", "́"]
GLUE = [" ", "  ", "\n", " '", "'s ", ", ", "", " ", " 12 ", "\t"]


class Counting:
    def __init__(self, library):
        self.library, self.chars = library, 0

    def encode_ordinary(self, text):
        self.chars += len(text)
        return self.library.encode_ordinary(text)

    def encode(self, text, **options):
        self.chars += len(text)
        return self.library.encode(text, **options)


def test_only_the_parts_around_unusual_characters_go_to_the_library(monkeypatch):
    rng = random.Random(2)
    ranks, words, pattern = queries.tokenizer_file("byte_bpe_multi_50k.tiktoken"), queries.tokenizer_file("word_bpe_49k.json"), queries.byte_pattern()
    texts = []
    for _ in range(200):
        t = "".join(rng.choice(["The", "Tokens", "don't", "naïve", "x", "中文", "Strasse"]) + rng.choice(GLUE + [" "] * 20) for _ in range(60))
        at = rng.randrange(len(t))
        texts.append(t[:at] + rng.choice(ODD) + t[at:])
    by_rank, by_word = Counting(encode.rank_library(ranks, pattern)), Counting(encode.word_library(words))
    want = [by_rank.library.encode_ordinary(t) for t in texts], [by_word.library.encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(encode, "rank_library", lambda *_: by_rank)
    for module in (encode, tokencount):
        monkeypatch.setattr(module, "word_library", lambda *_: by_word)
    for expected, path, given in ((want[0], ranks, pattern), (want[1], words, None)):
        ids, n = encode.ids_of(texts, path, given)
        assert n.tolist() == [len(x) for x in expected] and ids.tolist() == sum(expected, [])
    assert tokencount.count_texts(texts, words).tolist() == [len(x) for x in want[1]]
    whole = sum(map(len, texts))
    assert by_rank.chars < 0.3 * whole and by_word.chars < 0.6 * whole
    print("library chars", whole, by_rank.chars, by_word.chars)
