"""Families of loose copies: the right links, and few rows for them."""

import random

import pytest
from test_brute_force import shingles, smallest

from earshot.llm import minhash


def mix_of(paragraphs, n, seed, width=60):
    """Texts of 9 of the fixed paragraphs each, in order; the first twenty also with a few words changed."""
    rng = random.Random(seed)
    fixed = [[f"p{k}_{i}" for i in range(width)] for k in range(paragraphs)]
    texts = []
    for i in range(n):
        words = [w for k in sorted(rng.sample(range(paragraphs), 9)) for w in fixed[k]]
        texts.append(words)
        if i < 20:
            more = list(words)
            more[rng.randrange(len(more))] = f"new{i}"
            texts.append(more)
    rng.shuffle(texts)
    return [" ".join(t) for t in texts]


def test_links_of_a_loose_family(spark):
    texts = mix_of(14, 120, 3)
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    pairs = [(b, a) for a in sets for b in range(a) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = smallest(sets, pairs)
    out = minhash.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == want


@pytest.mark.parametrize("block", [512, 40])
def test_a_loose_family_gives_few_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    made = []
    for n in (150, 300):
        texts = [(i, t) for i, t in enumerate(dict.fromkeys(mix_of(14, n, 5)))]
        t = spark.createDataFrame(texts, "node long, text string")
        sets = [len(shingles(x)) for _, x in texts]
        nodes = spark.createDataFrame([(i, k, i) for (i, _), k in zip(texts, sets)], "node long, n long, component long")
        made.append((len(texts), minhash._rest_pairs(t, nodes, 85).count()))
    (n1, rows1), (n2, rows2) = made
    assert 0 < rows1 <= 3 * n1 and rows2 <= 3 * n2  # all pairs would be n * n / 2


def test_a_repeated_doc_id_is_two_documents(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    docs = spark.createDataFrame([(1, a), (2, a), (2, b)], "doc_id long, text string")
    assert sorted(map(tuple, minhash.deduplicate(docs).collect())) == [(1, a), (2, b)]
    assert sorted(map(tuple, minhash.groups(docs).collect())) == [(1, 36, 1), (2, 36, 1), (2, 36, 2)]
