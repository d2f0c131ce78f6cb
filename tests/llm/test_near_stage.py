"""The pipeline's stage of near copies against a join of all pairs."""

import random

import corpus_pipeline
from test_brute_force import shingles, smallest


def test_near_copies_from_eight_tenths(spark):
    rng = random.Random(11)
    fresh = lambda n: [f"o{rng.randrange(10**9)}" for _ in range(n)]
    texts = []
    for family in range(12):
        words = [f"w{family}_{k}" for k in range(104)]  # 100 shingles
        ends = [words[:-n] + fresh(n) for n in (11, 10, 11)]  # 0.80 to 0.82 with the first
        chain = fresh(11) + ends[0][11:]  # 0.80 with the second only
        texts += [words, *ends, chain, words[:46] + fresh(8) + words[54:]]  # the last below 0.8 with each
    texts = [" ".join(w) for w in texts] + ["a b", "", "c"]
    rng.shuffle(texts)
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    pairs = [(b, a, len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for a in sets for b in range(a) if sets[a] & sets[b]]
    want, high, low = (smallest(sets, [(b, a) for b, a, s in pairs if s >= least]) for least in (0.8, 0.85, 0.78))
    assert want != high and want != low
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_dedup(spark, docs, "")
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} == {i for i in sets if want[i] == i}


def test_long_copies_are_dealt_by_their_shingles(spark, monkeypatch):
    """A family of long near copies goes to groups that hold so many shingles, whatever their number; the links stay the same."""
    import random

    from earshot.llm import minhash

    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(1500)]
    texts = []
    for k in range(30):
        words = list(base)
        for i in rng.sample(range(len(words)), 12):
            words[i] = f"x{k}-{i}"
        texts.append((k, " ".join(words)))
    docs = spark.createDataFrame([*texts, (100, "short text of some words only here"), (101, "short text of some words only here now")], "doc_id long, text string")
    key = lambda: sorted(map(tuple, minhash.groups(docs).collect()))
    want = key()
    seen = []
    keep = minhash.materialize
    monkeypatch.setattr(minhash, "materialize", lambda df, name: (seen.append(df.groupBy("hub", "group").count().agg({"count": "max"}).first()[0]) if name == "dealt" else None) or keep(df, name))
    assert key() == want and seen[0] > 20
    seen.clear()
    monkeypatch.setattr(minhash, "TASK_SHINGLES", 4000)
    assert key() == want and seen[0] < 12
    assert {c for i, _, c in want if i < 100} == {0}
