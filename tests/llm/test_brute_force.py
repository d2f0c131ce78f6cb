"""Operators against plain Python over small fixtures."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from earshot.llm import bpe, bytebpe, encode, exact, graph, lattice, minhash, pii, quality, queries, suffix, tokencount, tokenfile

BYTES, WORD = queries.tokenizer_file("byte_bpe_multi_50k.tiktoken"), queries.tokenizer_file("word_bpe_49k.json")
CHARS = list("aB c  \n\t'sdtmlvr1٣é²Ωσ日本🙂!?  \x1c\x85_-éİΣ") + ["<|endoftext|>", "don't ", " the ", "'ll"]


def fuzz(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(CHARS) for _ in range(rng.randint(0, 40))) for _ in range(n)] + ["", "a" * 3000, "x\n\n\n y  ", "<|endoftext|>", " 's 'sun I'LL"]


@pytest.mark.parametrize("pattern", [queries.byte_pattern(), None], ids=["bytes", "words"])
def test_ids_equal_the_library(pattern):
    path = BYTES if pattern else WORD
    texts, got = fuzz(1500), []
    for _, part in encode.char_blocks(texts, 5000):
        ids, n = encode.ids_of(part, path, pattern)
        got += np.split(ids, np.cumsum(n)[:-1])
    for text, ids in zip(texts, got):
        want = encode.rank_library(path, pattern).encode_ordinary(text) if pattern else encode.word_library(path).encode(text, add_special_tokens=False).ids
        assert list(ids) == want
        if pattern:
            assert bpe.rank_file(path).decode(ids).tobytes() == text.encode()


def test_counts_and_prefixes_equal_the_library():
    texts, lib = fuzz(600, 2), encode.word_library(WORD)
    count = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    assert tokencount.count_texts(texts, WORD).tolist() == [count(t) for t in texts]
    for t in texts[:60]:
        assert tokencount.prefix_counts(t, WORD).tolist() == [count(t[:k]) for k in range(len(t) + 1)]


def test_budget(spark):
    text = "some words that make tokens don't they"
    kept = tokencount.fit_to_budget(spark.createDataFrame([(1, text)], "doc_id long, text string"), WORD, 4).first()["kept"]
    assert text.startswith(kept) and tokencount.count_texts([kept], WORD)[0] <= 4 < tokencount.count_texts([text[: len(kept) + 1]], WORD)[0]


def test_decode_is_the_inverse(spark):
    texts = [t for t in fuzz(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = bytebpe.decode(bytebpe.encode(docs, BYTES, queries.byte_pattern(), decode=False), BYTES).collect()
    assert {r["doc_id"]: bytes(r["decoded"]) for r in out} == {i: t.encode() for i, t in enumerate(texts)}


def spans_of(texts):
    from earshot.llm.vectext import Spans

    size = np.array([len(t) for t in texts])
    return Spans(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size, size)


@pytest.mark.parametrize("bits", [64, 6, 0])
def test_cache_compares_bytes_and_starts_anew(monkeypatch, bits):
    """Also where very many strings share a hash."""
    from earshot.llm.vectext import IdCache, Spans

    whole = Spans.hashes
    monkeypatch.setattr(Spans, "hashes", lambda self, seed=0: whole(self, seed) & np.uint64(2**bits - 1))
    cache, rng = IdCache(most=50), random.Random(0)
    for _ in range(30):
        texts = [bytes(rng.choices(b"abc", k=rng.choice((0, 1, 2, 3, 9, 17, 200)))) for _ in range(100)]
        make = lambda which, t=texts: (np.concatenate([np.frombuffer(t[i], np.uint8) for i in which] or [np.zeros(0, np.uint8)]).astype(np.uint32), np.array([len(t[i]) for i in which], np.int64))
        ids, n = cache.resolve(spans_of(texts), make)
        assert n.tolist() == [len(t) for t in texts] and bytes(ids.astype(np.uint8)) == b"".join(texts)


def thue_morse(n):
    """A text and its complement that every polynomial hash modulo a power of two takes for equal."""
    t = "a"
    while len(t) < n:
        t += t.translate(str.maketrans("ab", "ba"))
    return [t, t.translate(str.maketrans("ab", "ba"))]


LONG = {
    "thue-morse": thue_morse(4096), "run": ["=" * 5000], "period": ["abc" * 3000, "abcabcd" * 1500], "wide": ["日本" * 2000, "😂" * 1000],
    "letters": ["".join(random.Random(4).choices("etaoinshrdlu", k=k)) for k in (511, 513, 2049, 9001)], "tokens": ["".join(random.Random(5).choices(["the", "ing", "tion", "un"], k=4000))],
}


@pytest.mark.parametrize("kind", LONG)
def test_long_pieces_equal_the_library(kind):
    lib, ranks = encode.word_library(WORD), encode.rank_library(BYTES, queries.byte_pattern())
    for t in LONG[kind]:
        want = lib.encode(t, add_special_tokens=False).ids
        assert encode.ids_of([t], WORD)[0].tolist() == want and tokencount.count_texts([t], WORD)[0] == len(want)
        assert encode.ids_of([t], BYTES, queries.byte_pattern())[0].tolist() == ranks.encode_ordinary(t)
    both = encode.ids_of(LONG[kind], BYTES, queries.byte_pattern())[0]
    assert bpe.rank_file(BYTES).decode(both).tobytes() == "".join(LONG[kind]).encode()


def test_a_megabyte_without_spaces_takes_seconds():
    import time

    text = "".join(random.Random(6).choices("abcdefghijklmnopqrstuvwxyz", k=1 << 20))
    began = time.time()
    ids = encode.ids_of([text], BYTES, queries.byte_pattern())[0]
    n = tokencount.count_texts([text], WORD)[0]
    assert time.time() - began < 60  # a few seconds on an idle machine
    assert bpe.rank_file(BYTES).decode(ids).tobytes() == text.encode()
    assert n == len(encode.word_library(WORD).encode(text, add_special_tokens=False).ids)


def test_shingles_of_thue_morse_texts_differ():
    values, upto = minhash.shingle_sets([t.encode() for t in thue_morse(4096)])
    assert upto.tolist() == [0, 1, 2] and values[0] != values[1]


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("top", [1 << 16, 1 << 20])
def test_token_files(tmp_path, bits, top):
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 400, 50)
    ids, docs = rng.integers(0, top, counts.sum()), np.arange(50) * 7
    tokenfile.write_file(str(tmp_path / "x.ebp"), ids, docs, counts, bits)
    s = tokenfile.read_file(str(tmp_path / "x.ebp"))
    assert (s.read() == ids).all() and (s.documents()[0] == docs).all() and (s.documents()[1] == counts).all()
    small = tokenfile.Segment(tokenfile.pack(ids, docs, counts, bits, block=100))
    for a, n in ((0, 1), (99, 2), (150, 333), (len(ids) - 1, 5), (len(ids), 1)):
        assert (small.read(a, n) == ids[a : a + n]).all()


def test_token_files_in_order(spark):
    texts = fuzz(80, 4)
    docs = spark.createDataFrame([(i * 3 % 101, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    out = {r["doc_id"]: r for r in tokenfile.read_ids(spark, tokenfile.write_ids(docs, WORD, 2)).collect()}
    start = 0
    for d, t in sorted((i * 3 % 101, t) for i, t in enumerate(texts)):
        want = [*encode.word_library(WORD).encode(t, add_special_tokens=False).ids, 2]
        assert (out[d]["start"], out[d]["n_tokens"]) == (start, len(want)) and np.frombuffer(out[d]["ids"], "<u4").tolist() == want
        start += len(want)


@pytest.mark.parametrize("n", [0, 1, 2, 5, 100, 20000])
def test_static_filter(n):
    keys = np.random.default_rng(n).integers(1, 2**63, n).astype(np.uint64)
    keys = np.unique(keys)
    f = exact.build_filter(keys)
    assert exact.may_contain(f, keys).all()
    assert exact.may_contain(f, np.arange(1, 100001, dtype=np.uint64)).mean() < 1e-3
    assert len(f) < 2.9 * n + 1000


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def smallest(nodes, links):
    to = {n: n for n in nodes}

    def find(x):
        while to[x] != x:
            x = to[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        to[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_near_copies(spark, monkeypatch):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(500)}" for _ in range(rng.randint(3, 120))] for _ in range(6)]
    texts = []
    for _ in range(220):  # families whose members are linked to some of the others only
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, max(1, len(words) // 18))):
            words[rng.randrange(len(words))] = f"E{rng.randrange(40)}"
        texts.append(" ".join(words))
    texts += ["a b", "A  b", "", None, "c"]
    monkeypatch.setattr(minhash, "TASK_MEMBERS", 7)
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    links = []
    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                links.append((b, a))
    want = smallest(sets, links)
    out = minhash.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == {i: (len(s), want[i]) for i, s in sets.items()}


def test_components(spark):
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + k) for k in range(1, 50)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)]
    nodes = {x for a, b in links if a != b for x in (a, b)}
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == smallest(nodes, [(a, b) for a, b in links if a != b])


def test_near_embeddings(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((300, 64))
    x = np.concatenate((x, x[:200] + rng.standard_normal((200, 64)) * rng.uniform(0.05, 0.4, (200, 1)), x[:20], 3 * x[:5])).astype(np.float32)
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    want = smallest(range(len(x)), np.argwhere(np.triu(near)).tolist())
    out = lattice.linked(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()
    got = np.array([r["n_links"] for r in sorted(out, key=lambda r: r["vec_id"])])
    assert (got <= near.sum(axis=1)).all() and got.sum() >= 0.99 * near.sum()
    assert {r["vec_id"]: r["component_id"] for r in out} == want


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(8)
    x = rng.uniform(-2, 2, (200, 8))
    at = lattice.nearest_e8(x)
    assert len(lattice.minimal_vectors()) == 240
    far = ((x - at / 2) ** 2).sum(axis=1)
    for v in lattice.minimal_vectors():
        assert (far <= ((x - (at + v) / 2) ** 2).sum(axis=1) + 1e-9).all()


def brute_cut(docs):
    first: dict[bytes, int] = {}
    for i, t in docs:
        for p in range(len(t) - 49):
            g = t[p : p + 50]
            first[g] = min(first.get(g, i), i)
    out = []
    for i, t in docs:
        gone = bytearray(len(t))
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(t, gone) if not g)
        runs = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [1000, 3])
def test_repeats(spark, monkeypatch, hot):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 40))) for _ in range(8)]
    texts = [" ".join(rng.choice(passages) if rng.random() < 0.4 else " ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(0, 6))) for _ in range(150)]
    texts += [None, "", "a" * 500, "a" * 49, "a" * 50, "ab" * 200, "b" + "a" * 70 + "b", texts[5], texts[5], "\0" * 60, "x" + "\0" * 60]
    rng.shuffle(texts)
    monkeypatch.setattr(suffix, "HOT", hot)
    rows = list(enumerate(texts))
    out = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out)
    assert got == brute_cut([(i, (t or "").encode()) for i, t in rows])
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in out)


def test_suffix_order():
    data = np.frombuffer(("banana bandana " * 40).encode(), np.uint8)
    order, raw = suffix.suffix_order(data), data.tobytes()
    cut = [raw[i : i + 64] for i in order]
    assert cut == sorted(cut)
    begin, end = np.array([0]), np.array([len(data)])
    shared = suffix.common_prefixes(data, order, begin, end)
    for a, b in zip(order[:-1].tolist(), order[1:].tolist()):
        n = 0
        while n < 50 and max(a, b) + n < len(raw) and raw[a + n] == raw[b + n]:
            n += 1
        assert shared[b] == n


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(t):
    out = []
    for rank, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m.group())
            bad = (kind == "ip" and any(int(x) > 255 for x in m.group().split("."))) or (kind == "card" and not (14 <= len(d) <= 19 and luhn(d))) or (kind == "phone" and not 10 <= len(d) <= 15)
            if not bad:
                out.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


def test_personal_data(spark):
    rng = random.Random(10)
    parts = [*"ab@.-_+ ()0123456789é🙂", "4111 1111 1111 1111", "1.2.3.4", "+31 20 123 4567", "a@b.c", "@x.y"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["", None, "1 " * 3000, "5" * 3000 + "@", "a." * 3000 + "@b"]
    out = pii.spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r["doc_id"]: r["s"] for r in out.select("doc_id", pii.joined(pii.base_only(out["spans"])).alias("s")).collect()}
    assert got == {i: base_spans(t or "") for i, t in enumerate(texts)}


def test_added_kinds(spark):
    texts = ["iban GB82 WEST 1234 5698 7654 32 ok", "iban GB83 WEST 1234 5698 7654 32 ok", "my ssn is 123-45-6789.", "part 123-45-6789."]
    out = pii.spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert [r[0] for r in out.orderBy("doc_id").select(pii.joined(out["spans"])).collect()] == ["iban:5:32", "", "ssn:10:21", ""]


def test_hinge_model_on_separable_rows():
    x = [(np.array([0, 1 + k % 3]), np.array([1.0, 0.5])) for k in range(60)]
    y = np.array([1.0 if k % 3 == 0 else -1.0 for k in range(60)])
    w = quality.fit_hinge(x, y, 4, np.full(60, 10.0), passes=200)
    assert all(y[k] * (w[i] @ v) > 0.95 for k, (i, v) in enumerate(x))


def test_held_out_accuracy(spark):
    """On the documents themselves: rejects most junk that it never saw, and next to nothing else."""
    at = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    rows = [r for r in queries.op1_quality(spark, at).collect() if r["held_out"] and r["doc_id"] in labels]
    by = defaultdict(list)
    for r in rows:
        by[labels[r["doc_id"]]].append(r)
    assert np.mean([r["predicted"] for r in by[1]]) > 0.97
    pairs = [(a["score"] > b["score"]) for a in by[1] for b in by[0]]
    assert np.mean(pairs) > 0.9


def test_queries_and_sql_match_names():
    assert set(queries.oracle_sql()) <= set(queries.queries())
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in queries.queries()) == list(range(1, 14))
