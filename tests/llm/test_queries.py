"""Each registered query over a small folder of tables against plain Python, column by column."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_brute_force import base_spans, brute_cut, shingles, smallest

import corpus_pipeline
from earshot.llm import encode, quality, queries
from earshot.llm.queries import byte_pattern, tokenizer_file

SPACES = r"[\x20\x09-\x0D]+"


def made(seed=21):
    """Documents with copies, near copies, shared passages, personal data, odd texts and nulls; embeddings with families."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = prose(60)
    texts = [prose(rng.randint(1, 120)) for _ in range(60)]
    texts += [t.replace(" ", "  ") for t in texts[:8]] + [texts[3]] * 4
    for t in texts[8:20]:
        w = t.split()
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    texts += [f"{prose(20)} {passage} {prose(10)}" for _ in range(5)]
    texts += [f"write to {w}@example.org or +31 20 123 45{k:02d}, card 4111 1111 1111 1111, host 10.0.0.{k}" for k, w in enumerate(words[:6])]
    texts += [None, "", " \n", "one two", "x" * 3000, "naïve 日本語 🙂 ﬁ İ", "<|endoftext|> it's", "bad%% $$ ## @@ " * 12, "a b c d e f g " * 40]
    rng.shuffle(texts)
    n = len(texts)
    ids = rng.sample(range(10**6), n)
    documents = pa.table({
        "doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array(["en"] * n), "source": pa.array([rng.choice(["s1", "s2", "hot", "hot", "hot", None]) for _ in range(n)]),
        "n_chars": pa.array([len(t or "") for t in texts], pa.int64()),
    })
    known = [(i, 0 if re.search("%%|abc|x{9}|(.)\\1\\1", t or "") or len((t or "").split()) < 4 else 1) for i, t in zip(ids, texts) if rng.random() < 0.9]
    labels = pa.table({"doc_id": pa.array([i for i, _ in known], pa.int64()), "quality": pa.array([q for _, q in known], pa.int32()), "toxic": pa.array([0] * len(known), pa.int32())})
    g = np.random.default_rng(seed)
    base = g.standard_normal((40, 64))
    near = base[:20] + 0.15 * g.standard_normal((20, 64))
    x = np.concatenate((base, near, np.repeat(base[:1], 6, axis=0) + 0.02 * g.standard_normal((6, 64)), base[:3])).astype(np.float32)
    embeddings = pa.table({"vec_id": pa.array(g.permutation(len(x) * 3)[: len(x)], pa.int64()), "embedding": pa.array(x.tolist(), pa.list_(pa.float32())), "label": pa.array([0] * len(x), pa.int32())})
    return documents, labels, embeddings


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    documents, labels, embeddings = made()
    for name, t in (("documents", documents), ("labels", labels), ("embeddings", embeddings)):
        pq.write_table(t, at / f"{name}.parquet")
    return str(at), list(zip(documents["doc_id"].to_pylist(), documents["text"].to_pylist(), documents["source"].to_pylist())), embeddings


def rows_of(spark, tables, name):
    return [r.asDict() for r in queries.queries()[name](spark, tables[0]).collect()]


def by_id(rows, key="doc_id"):
    out = {r[key]: r for r in rows}
    assert len(out) == len(rows)
    return out


def ids_of(text):
    return encode.word_library(tokenizer_file("word_bpe_49k.json")).encode(text, add_special_tokens=False).ids


def test_op1(spark, tables):
    got = by_id(rows_of(spark, tables, "op1_quality"))
    assert set(got) == {i for i, *_ in tables[1]}
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    # The fitted model from counts, ratios and scores in plain Python.
    docs, labels = spark.read.parquet(f"{tables[0]}/documents.parquet"), spark.read.parquet(f"{tables[0]}/labels.parquet")
    model = quality.fit(docs, labels, ~queries.held_out())
    label = {r["doc_id"]: r["quality"] for r in labels.collect()}
    sets = {i: set(quality.features([(t or "").encode()])[0].tolist()) for i, t, _ in tables[1]}
    counts, number = np.zeros((2, 1 << quality.BITS)), [0, 0]
    for i in label:
        if not got[i]["held_out"]:
            number[label[i]] += 1
            for f in sets[i]:
                counts[label[i], f] += 1
    share = [2 * quality.SMOOTH * n / sum(number) for n in number]
    ratio = np.log((counts[1] + share[1]) / number[1]) - np.log((counts[0] + share[0]) / number[0])
    assert np.allclose(model.ratio, ratio, atol=1e-5)
    for i, r in got.items():
        f = sorted(sets[i])
        length = max(sum(ratio[k] ** 2 for k in f), 1e-12) ** 0.5
        margin = sum(float(model.product[k]) for k in f) / length + model.bias
        assert abs(r["score"] - 1 / (1 + np.exp(-(model.slope * margin + model.offset)))) < 1e-4


def test_grams_of_a_text_don_t_depend_on_its_block():
    texts = [(t or "").encode() for t in made()[0]["text"].to_pylist()]
    index, upto = quality.features(texts)
    for k, t in enumerate(texts):
        assert index[upto[k] : upto[k + 1]].tolist() == quality.features([t])[0].tolist()


def test_curve_is_where_its_gradient_vanishes():
    rng = np.random.default_rng(1)
    margin = rng.normal(0, 2, 400)
    label = (rng.random(400) < 1 / (1 + np.exp(-(1.5 * margin - 0.7)))).astype(float)
    a, b = quality.fit_curve(margin, label)
    n1, n0 = label.sum(), (1 - label).sum()
    gap = 1 / (1 + np.exp(-(a * margin + b))) - np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    assert abs((gap * margin).sum()) < 1e-5 and abs(gap.sum()) < 1e-5


def test_op2(spark, tables):
    first, again = (by_id(rows_of(spark, tables, "op2_mixing")) for _ in range(2))
    assert first == again
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in tables[1]}
    sources = sorted({s for *_, s in tables[1] if s is not None}) + [None]
    total = {s: sum(sizes[i] for i, _, x in tables[1] if x == s) for s in sources}
    weight, left, target = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}, set(sources), {}
    rest = sum(total.values())
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 3 * total[s]}
        if not over:
            break
        for s in over:
            target[s], rest = 3.0 * total[s], rest - 3 * total[s]
        left -= over
    target |= share
    for i, _, s in tables[1]:
        r = first[i]
        assert r["size"] == sizes[i] and r["source_size"] == total[s] and abs(r["target"] - target[s]) < 1e-6 * target[s] + 1e-9
        rate = target[s] / total[s]
        assert r["taken"] in {sizes[i] * int(rate), sizes[i] * (int(rate) + 1)} and r["taken"] <= 3 * sizes[i]


def test_sums_come_near_their_targets(spark, sf_dir):
    """What is taken of each source differs from its target by no more than the drawn copies can: a few standard deviations of their sizes."""
    rows = queries.op2_mixing(spark, "/root/testdata/sf0.01").collect()
    by_target = {}
    for r in rows:
        by_target.setdefault((r["source_size"], r["target"]), []).append(r)
    for (whole, target), some in by_target.items():
        part = (target / whole) % 1
        spread = (part * (1 - part) * sum(r["size"] ** 2 for r in some)) ** 0.5
        assert abs(sum(r["taken"] for r in some) - target) <= 4.5 * spread + 1e-6 * target
    assert abs(sum(r["taken"] for r in rows) / sum(r["size"] for r in rows) - 1) < 0.1


def test_op3(spark, tables):
    lib = encode.rank_library(tokenizer_file("byte_bpe_multi_50k.tiktoken"), byte_pattern())
    got = by_id(rows_of(spark, tables, "op3_byte_bpe"))
    for i, t, _ in tables[1]:
        ids = lib.encode_ordinary(t or "")
        assert got[i] == {"doc_id": i, "n_tokens": len(ids), "ids_sha256": hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), "decoded_sha256": hashlib.sha256((t or "").encode()).hexdigest()}


def test_op4(spark, tables):
    got = by_id(rows_of(spark, tables, "op4_pii"))
    for i, t, _ in tables[1]:
        want, r = base_spans(t or ""), got[i]
        kinds = [s.split(":")[0] for s in want.split(",") if s]
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [kinds.count(k) for k in ("email", "ip", "card", "phone")]
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and set(filter(None, want.split(","))) <= set(r["spans"].split(","))


def test_op5(spark, tables):
    got = by_id(rows_of(spark, tables, "op5_minhash_dedup"))
    sets = {i: shingles(t or "") for i, t, _ in tables[1]}
    ids = sorted(sets)
    pairs = [(b, a) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = smallest(sets, pairs)
    assert pairs and got == {i: {"doc_id": i, "n_shingles": len(sets[i]), "component_id": want[i], "kept": want[i] == i} for i in ids}


def test_op6(spark, tables):
    got = by_id(rows_of(spark, tables, "op6_embedding_dedup"), "vec_id")
    ids, x = tables[2]["vec_id"].to_pylist(), np.array(tables[2]["embedding"].to_pylist())
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = x @ x.T >= 0.95
    want = smallest({i: None for i in ids}, [(a, b) for k, a in enumerate(ids) for m, b in enumerate(ids) if close[k, m] and a < b])
    assert (close.sum() - len(ids)) > 60
    assert got == {i: {"vec_id": i, "n_links": int(close[k].sum()) - 1, "component_id": want[i], "kept": want[i] == i} for k, i in enumerate(ids)}


def test_op7(spark, tables):
    got, norm = by_id(rows_of(spark, tables, "op7_exact_dedup")), {i: re.sub(SPACES, " ", t or "") for i, t, _ in tables[1]}
    for i, n in norm.items():
        same = [j for j, m in norm.items() if m == n]
        assert got[i] == {"doc_id": i, "keep_id": min(same), "group_size": len(same), "kept": min(same) == i, "text_sha256": hashlib.sha256(n.encode()).hexdigest()}


def test_op8(spark, tables):
    got = by_id(rows_of(spark, tables, "op8_token_counts"))
    for i, t, _ in tables[1]:
        n = len(ids_of(t or ""))
        assert got[i] == {"doc_id": i, "n_bytes": len((t or "").encode()), "n_tokens": n, "over_limit": n > 2048}


def test_op9(spark, tables):
    got, start = by_id(rows_of(spark, tables, "op9_token_files")), 0
    for i, t, _ in sorted(tables[1]):
        ids = [*ids_of(t or ""), 2]
        assert got[i] == {"doc_id": i, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(np.array(ids, "<u4").tobytes())}
        start += len(ids)


def test_op10(spark, tables):
    rows = rows_of(spark, tables, "op10_suffix_dedup")
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows)
    assert got == brute_cut([(i, (t or "").encode()) for i, t, _ in tables[1]]) and sum(r[2] for r in got) > 1000


def test_pipeline(spark, tables):
    out = corpus_pipeline.run(spark, tables[0]).collect()
    text = {i: t or "" for i, t, _ in tables[1]}
    lib = encode.rank_library(tokenizer_file("byte_bpe_multi_50k.tiktoken"), byte_pattern())
    assert out and all(np.frombuffer(r["ids"], "<u4").tolist() == lib.encode_ordinary(text[r["doc_id"]]) for r in out)
    assert len({re.sub(SPACES, " ", text[r["doc_id"]]) for r in out}) == len({r["doc_id"] for r in out})


DOCS = "doc_id long, text string, lang string, source string, n_chars long, _row string, label int, sha string"


@pytest.mark.parametrize("rows", ["odd", "empty"])
def test_stages_take_anything(spark, tables, rows):
    """Nulls in every column, repeated rows and ids, empty and long texts, clashing names."""
    good = "plain words that make a sentence of some length, nothing else than that"
    odd = [(1, good), (1, good), (2, good), (2, "another text with quite other words in it, and a few more than before"), (None, good), (None, None), (3, None), (4, ""), (5, "long words " * 4000), (6, good + " too")]
    given = [(i, t, None, "s" if i else None, None, "x", 1, "y") for i, t in odd] if rows == "odd" else []
    docs = spark.createDataFrame(given, DOCS)
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, tables[0])
        if name != "encode":
            assert after.columns == docs.columns
            assert {tuple(r) for r in after.collect()} <= {tuple(r) for r in docs.collect()}
        elif rows == "empty":
            assert after.count() == 0
        else:
            lone = spark.createDataFrame(given, DOCS)
            assert stage(spark, lone, tables[0]).count() == len(given)
        if rows == "odd" and name == "exact_dedup":
            kept = [(r["doc_id"], r["text"]) for r in stage(spark, spark.createDataFrame(given, DOCS), tables[0]).collect()]
            assert kept.count((1, good)) == 2 and (2, good) not in kept and (2, odd[3][1]) in kept and kept.count((None, good)) == 1
        docs = after
