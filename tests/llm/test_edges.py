"""Nulls in any column, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import pytest

from earshot.llm import bytebpe, exact, lattice, minhash, mixing, pii, quality, queries, suffix, tokencount, tokenfile

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, sha string, spans string, score double, node int, n int, bucket int, pack int, label int, component string, _new int, ids int, target string, key string, part int"
WORDS = "word1 word2 word3 word4 word5 word6 word7 word8"


def row(i, text, source="s"):
    return (i, text, "en", source, None if text is None else len(text), 1, "x", "y", 0.5, 1, 2, 3, 4, 5, "z", 6, 7, "t", "k", 8)


ROWS = [row(1, WORDS), row(2, WORDS), row(2, WORDS), row(3, None), row(4, ""), row(None, WORDS), row(None, None, None), row(5, " \t\n"), row(6, "long text " * 3000, "hot"), row(7, "a@b.co +31 20 123 4567 " * 200, "hot"), row(8, "ü🙂\0 x", None), row(9, "x" * 20000)]


@pytest.fixture(scope="module")
def word_file():
    return queries.tokenizer_file("word_bpe_49k.json")


def docs_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


OPERATORS = {
    "quality": lambda d, w: quality.score(d, quality.neutral()),
    "quality_keep": lambda d, w: quality.keep(d, quality.neutral(), 0.3),
    "mixing": lambda d, w: mixing.with_copies(d),
    "bpe": lambda d, w: bytebpe.encode(d, queries.tokenizer_file("byte_bpe_multi_50k.tiktoken"), queries.byte_pattern()),
    "pii": lambda d, w: pii.spans(d),
    "pii_redact": lambda d, w: pii.redact(d),
    "minhash": lambda d, w: minhash.groups(d),
    "exact": lambda d, w: exact.groups(d),
    "counts": lambda d, w: tokencount.token_counts(d, w),
    "files": lambda d, w: tokenfile.read_ids(d.sparkSession, tokenfile.write_ids(d, w, 2)),
    "suffix": lambda d, w: suffix.remove_repeats(d),
}


@pytest.mark.parametrize("name", OPERATORS)
@pytest.mark.parametrize("rows", [ROWS, []], ids=["odd", "empty"])
def test_one_row_out_for_each_in(spark, word_file, name, rows):
    out = OPERATORS[name](docs_of(spark, rows), word_file)
    assert out.count() == len(rows)
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in out.collect())
    assert got == sorted((r[0] is not None, r[0] or 0) for r in rows)


@pytest.mark.parametrize("name", ["exact", "minhash", "mix"])
def test_rows_that_stay_keep_their_columns(spark, name):
    d = docs_of(spark, ROWS)
    out = {"exact": exact.deduplicate, "minhash": minhash.deduplicate, "mix": mixing.mix}[name](d)
    assert out.columns == d.columns
    rows = out.collect()
    if name != "mix":
        ids = [r["doc_id"] for r in rows]
        assert 1 in ids and ids.count(2) == 0 and ids.count(None) == 2  # copies of 1 go, rows without doc_id stay
    assert all(r["sha"] == "x" and r["_new"] == 6 and r["target"] == "t" for r in rows)
    assert docs_of(spark, []).transform({"exact": exact.deduplicate, "minhash": minhash.deduplicate, "mix": mixing.mix}[name]).count() == 0


def test_redact_keeps_other_columns(spark):
    out = pii.redact(docs_of(spark, [row(1, "mail a@b.co now")])).first()
    assert out["text"] == "mail [email] now" and out["spans"] == "y"


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0, "a"), (2, [2.0, 0.0], 0, "a"), (2, [1.0, 0.0], 0, "a"), (3, None, None, "a"), (4, [], 1, "a"), (5, [0.0, 0.0], 1, "a"), (6, [nan, 1.0], 1, "a"), (7, [inf, 1.0], 1, "a"), (8, [None, 1.0], 1, "a"), (None, [1.0, 0.0], 1, "a"), (9, [1.0, 0.0, 0.0], 1, "a"), (10, [1e-30, 0.0], 1, "a")]
    out = lattice.linked(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node string")).collect()
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in out)
    lone = [(i, 0, i) for i in (3, 4, 5, 6, 7, 8, 9)]
    assert got == sorted([(0, 0, None), (1, 3, 1), (2, 3, 1), (2, 3, 1), (10, 3, 1), *lone])
    assert lattice.linked(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_labels_with_nulls_and_repeats(spark):
    d = spark.createDataFrame([(i, "good text here" if i % 2 else "bad%%% text%%%") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(0, None, 0), (None, 1, 0), (1, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(d, labels, ~queries.held_out())
    s = {r["doc_id"]: r["score"] for r in quality.score(d, model).collect()}
    assert min(s[i] for i in range(1, 60, 2)) > max(s[i] for i in range(0, 60, 2))
    none = quality.fit(d, labels.filter("quality = 1"), ~queries.held_out())
    assert {r["score"] for r in quality.score(d, none).collect()} == {0.5}


def test_sources_tie_and_null(spark):
    rows = [(1, "a b c", "b"), (2, None, "b"), (3, "x", None), (4, "", "a"), (5, "q " * 50, "a")]
    out = {r["doc_id"]: r for r in mixing.with_copies(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert [out[i]["_mix_size"] for i in (1, 2, 3, 4, 5)] == [3, 0, 1, 0, 50]
    assert out[1]["_mix_target"] == 9.0 and out[3]["_mix_target"] == 3.0 and abs(out[5]["_mix_target"] - 42.0) < 1e-9


def test_a_row_without_a_copy_stays_where_its_doc_id_repeats(spark):
    docs = spark.createDataFrame([(1, "A A"), (2, "A  A"), (2, "B")], "doc_id long, text string")
    assert sorted(map(tuple, exact.deduplicate(docs).collect())) == [(1, "A A"), (2, "B")]


def test_extreme_ids_come_back(spark, word_file):
    ids = [-(2**63), 2**63 - 1, None, 0]
    docs = spark.createDataFrame([(i, WORDS) for i in ids], "doc_id long, text string")
    key = lambda rows: sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in rows)
    want = sorted((i is not None, i or 0) for i in ids)
    assert key(tokenfile.read_ids(spark, tokenfile.write_ids(docs, word_file, 2)).collect()) == want
    assert key(suffix.remove_repeats(docs).collect()) == want


def test_small_helpers_take_nulls_and_nothing(spark, word_file):
    from earshot.llm import graph

    d = docs_of(spark, [row(1, None), row(1, ""), row(None, "three plain words"), row(2, "naïve ﬁ text and more ﬁ words here")])
    kept = sorted((r["doc_id"] or 0, r["kept"]) for r in tokencount.fit_to_budget(d, word_file, 3).collect())
    assert kept[0] == (0, "three plain words") and kept[1:3] == [(1, ""), (1, "")] and len(kept) == 4
    assert {r["kept"] for r in tokencount.fit_to_budget(d, word_file, -1).collect()} == {""}
    assert tokencount.fit_to_budget(docs_of(spark, []), word_file, 3).count() == 0
    path = queries.tokenizer_file("byte_bpe_multi_50k.tiktoken")
    ids = spark.createDataFrame([(1, None, "x"), (1, bytearray(), "x"), (None, bytearray(b"\x00\x00\x00\x00"), "x")], "doc_id long, ids binary, decoded string")
    assert sorted(len(r["decoded"]) for r in bytebpe.decode(ids, path).collect()) == [0, 0, 1]
    assert bytebpe.decode(ids.limit(0), path).count() == 0
    links = spark.createDataFrame([(1, 2), (2, 1), (1, 2), (3, 3), (None, 4), (5, None)], "a long, b long")
    assert sorted(map(tuple, graph.components(links).collect())) == [(1, 1), (2, 1)]
    assert graph.components(links.limit(0)).count() == 0
    assert pii.redact(docs_of(spark, [])).count() == 0 and pii.redact(docs_of(spark, [row(1, None)])).first()["text"] == ""


def test_prefix_counts_of_odd_texts_add_up(word_file):
    from earshot.llm import encode

    text = "naïve ﬁ words and ﬁ more İ text with words"
    lib = encode.word_library(word_file)
    assert tokencount.prefix_counts(text, word_file).tolist() == [len(lib.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]


def test_prefix_counts_of_long_odd_texts(word_file):
    """A long text of odd words in about the time of its words, each prefix by the library."""
    import time

    from earshot.llm import encode

    words = ["\U0001f680", "na\u0131ve\U0001f680x", "\u20b9\u20b9", "e\u0301t\u0301", "\U0001fae0 \u0301a", "12\U0001f6803"]
    text = " ".join(words * 700)
    began = time.time()
    got = tokencount.prefix_counts(text, word_file)
    assert len(text) > 15_000 and time.time() - began < 20
    lib = encode.word_library(word_file)
    for k in [*range(200), *range(200, len(text) + 1, 997), len(text)]:
        assert got[k] == len(lib.encode(text[:k], add_special_tokens=False).ids), k


NAMES = ["_even", "_text", "_m_email", "x.y", "_row", "_mix_size", "a b`c", "_doc", "_digest", "Spans", "_sha", "_part", "key", "tree", "marks", "A"]


@pytest.mark.parametrize("name", ["exact", "minhash", "mix", "keep", "spans", "redact"])
def test_columns_of_any_name_come_back(spark, name):
    rows = [(r[0], r[1], r[3], *[f"{k}-{i}" for k in range(len(NAMES))]) for i, r in enumerate(ROWS)]
    fields = ["doc_id long", "text string", "source string", *[f"`{c.replace('`', '``')}` string" for c in NAMES]]
    d = spark.createDataFrame(rows, ", ".join(fields))
    run = {"exact": exact.deduplicate, "minhash": minhash.deduplicate, "mix": mixing.mix, "keep": lambda x: quality.keep(x, quality.neutral(), 0.3), "spans": pii.spans, "redact": pii.redact}[name]
    if name == "spans":
        d = d.drop("Spans")
    out = run(d)
    assert out.columns == d.columns + ["spans"] * (name == "spans")
    given = {tuple(r)[2:] for r in d.collect()}
    got = [tuple(r)[2 : len(d.columns)] for r in out.collect()]
    assert got and set(got) <= given and (name in ("exact", "minhash", "mix") or len(got) == len(rows))


def test_joins_leave_clashing_names(spark):
    from earshot.llm import session

    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, _even string")
    b = spark.createDataFrame([(1, "z")], "k int, __even string")
    assert [tuple(r) for r in session.join_even(a, b, ["k"]).collect()] == [(1, "x", "z")]
