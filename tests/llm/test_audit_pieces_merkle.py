"""Filter audit, pieces and manifest over a small folder of tables against plain Python, the library and their SQL."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from test_edges import ROWS, docs_of, row
from test_queries import by_id, rows_of, tables  # noqa: F401

from earshot.llm import audit, merkle, piece, queries
from earshot.llm.queries import tokenizer_file

WORD = r"[^\x20\x09-\x0D]+"


def failing(docs):
    """The filters that each row (doc_id, text, source) fails."""
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, t, source in docs:
        t = t or ""
        words = re.findall(WORD, t)
        out = {"A"} if len(words) < 200 else set()
        out |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        out |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t) else set()
        out |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        out |= {"E"} if i is not None and first[t] < i else set()
        yield source or "", out


def brute_audit(docs, good=(), toxic=()):
    parts, want = {}, []
    for (i, *_), (part, fails) in zip(docs, failing(docs)):
        parts.setdefault(part, []).append((fails, i in good, i in toxic))
    for part, rows in parts.items():
        shapley, made = dict.fromkeys("ABCDE", 0), []
        for order in itertools.permutations("ABCDE"):
            left = rows
            for k, f in enumerate(order):
                out, stay = [r for r in left if f in r[0]], [r for r in left if f not in r[0]]
                shapley[f] += len(out)
                redundant = sum(f in r[0] for r in rows) - len(out)
                made.append((part, "".join(order), k + 1, len(stay), len(out), redundant, sum(r[0] == {f} for r in rows), sum(r[1] for r in out), sum(r[2] for r in out), f))
                left = stay
        want += [(*m[:-1], shapley[m[-1]]) for m in made]
    return sorted(want)


def test_op11(spark, tables):  # noqa: F811
    label = {r["doc_id"]: r for r in spark.read.parquet(f"{tables[0]}/labels.parquet").collect()}
    good = {i for i, r in label.items() if r["quality"] == 1}
    want = brute_audit(tables[1], good)
    assert sorted(tuple(r.values()) for r in rows_of(spark, tables, "op11_filter_audit")) == want
    assert any(r[-2] == 0 and r[7] > 0 for r in want) and len({r[3] for r in want}) > 5


def test_audit_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, None), (1, None, 1), (2, None, None), (None, 1, 1), (99, 1, 1), (7, 0, 1)], "doc_id long, quality int, toxic int")
    got = audit.audit(docs_of(spark, ROWS), labels)
    assert sorted(map(tuple, got.collect())) == brute_audit([(r[0], r[1], r[3]) for r in ROWS], {1}, {1, 7})
    assert audit.audit(docs_of(spark, []), labels).count() == 0
    none = audit.audit(docs_of(spark, ROWS), labels.limit(0))
    assert none.agg({"good_lost": "max"}).first()[0] == 0


@pytest.mark.parametrize("block", [1, 64, 1000])
def test_bitmaps_of_blocks_of_any_size(spark, monkeypatch, block):
    rng = random.Random(block)
    rows = [(rng.choice(["a", "b", "hot", "hot", "hot", ""]), *[rng.random() < 0.4 for _ in range(3)], rng.random() < 0.5) for _ in range(700)]
    monkeypatch.setattr(audit, "BLOCK", block)
    df = spark.createDataFrame(rows, "part string, x boolean, y boolean, z boolean, seen boolean").repartition(3)
    index = audit.bitmap_index(df, ("x", "y", "z", "seen"))
    for r in index.collect():
        assert len(r["marks"]) == len(r["x"]) == -(-r["n"] // 64) * 8
    got = {(r["part"], r["subset"]): (r["kept"], r["seen"]) for r in audit.subset_counts(index, ("x", "y", "z"), ("seen",)).collect()}
    for (part, subset), n in got.items():
        left = [r for r in rows if r[0] == part and not any(r[1 + k] for k in range(3) if subset >> k & 1)]
        assert n == (len(left), sum(r[4] for r in left))
    assert len(got) == 4 * 8


def test_long_texts_count_the_same_words(monkeypatch):
    texts = [b"", b" \t", b"a b a\x0bc \x1f\x85 b", b"x" * 100, "ä ö ä b".encode() * 9]
    want = [audit._words(t) for t in texts]
    monkeypatch.setattr(audit, "LONG", 0)
    assert [audit._words(t) for t in texts] == want
    assert want == [(len(w), len(set(w))) for w in (re.findall(WORD.encode(), t) for t in texts)]


PATH = "piece_bpe_32k.model"
TEXTS = ["", " ", "  ", "a", " a", "a ", "a  b   c    ", "▁", "▁ ▁x", "a▁b", "\n", "a\tb\r\n c", "<s> </s> <unk> <0x41>", "ﬁ ½ é é ⁇", "日本語 テキスト", "🙂👩‍👩‍👧", "　x y​z", "\x00", "a\x00 b", "word " * 3000, "x" * 30000, " " * 70, "naïve Ünïcode"]


@pytest.fixture(scope="module")
def own():
    return piece.Pieces(tokenizer_file(PATH))


def test_pieces_of_odd_and_random_texts(own):
    rng = random.Random(5)
    alphabet = ["a", "e", "t", "th", "ing", "er", " ", "  ", " ", "▁", "\n", "é", "日", "🙂", "1", "0", ".", " ", "the", "\x00", "́"]
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    ids, n = own.ids_of(texts)
    runs = np.split(ids, np.cumsum(n)[:-1])
    data, size = own.decode(ids, n)
    out = [x.tobytes().decode() for x in np.split(data, np.cumsum(size)[:-1])]
    for t, x, d in zip(texts, runs, out):
        want = own.model.encode(t, add_bos=True, add_eos=True)
        assert x.tolist() == want and d == own.model.decode(want), t


def test_decode_of_any_ids(spark, own):
    rng = random.Random(6)
    runs = [[], [1, 2], [0], [1, 0, 5], [259], [300, 1, 300], [200, 201], [own.mark] * 3] + [[rng.randrange(32000) if rng.random() < 0.7 else rng.randrange(3, 259) for _ in range(rng.randint(1, 20))] for _ in range(300)]
    rows = [(k, np.array(x, "<u4").tobytes(), "y") for k, x in enumerate(runs)]
    got = {r["doc_id"]: r["decoded"] for r in piece.decode(spark.createDataFrame([*rows, (None, None, "y")], "doc_id long, ids binary, decoded string"), tokenizer_file(PATH)).collect()}
    assert got.pop(None) == ""
    assert got == {k: own.model.decode(x) for k, x in enumerate(runs)}
    assert piece.decode(spark.createDataFrame([], "doc_id long, ids binary"), tokenizer_file(PATH)).count() == 0
    with pytest.raises(ValueError):
        own.decode(np.array([32000], np.uint32), np.array([1]))


def test_whole_texts_where_pieces_cross_markers(own):
    texts = [*TEXTS[:10], "some words of a text", "x" * 2000]
    want = own.ids_of(texts)
    other = piece.Pieces(tokenizer_file(PATH))
    other.apart = False
    assert all(np.array_equal(a, b) for a, b in zip(want, other.ids_of(texts)))


def test_op12(spark, tables, own):  # noqa: F811
    got = by_id(rows_of(spark, tables, "op12_sentencepiece"))
    for i, t, _ in tables[1]:
        ids = own.model.encode(t or "", add_bos=True, add_eos=True)
        assert got[i] == {"doc_id": i, "n_tokens": len(ids), "ids_sha256": hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), "decoded_sha256": hashlib.sha256(own.model.decode(ids).encode()).hexdigest()}


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(values):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def grown(nodes):
    """Levels of a tree from its leaves to its top."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][k : k + 16]) for k in range(0, len(levels[-1]), 16)])
    return levels


def up(levels, at, value):
    """Siblings on the way up, and what ``value`` folds to."""
    proof = []
    for level in levels[:-1]:
        first = at - at % 16
        run = level[first : first + 16]
        proof += run[: at - first] + run[at - first + 1 :]
        value = digest(*run[: at - first], value, *run[at - first + 1 :])
        at = first // 16
    return proof, value


def brute_merkle(docs):
    """Per row of (doc_id, source, lang, n_chars, text): what op13 gives."""
    by_source = {}
    for d in docs:
        by_source.setdefault(d[1], []).append(d)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    low = lambda t: None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    trees = {}
    for s in order:
        rows = sorted(by_source[s], key=lambda d: (d[0] is not None, d[0] or 0, leaf_of(d)))
        trees[s] = rows, grown([leaf_of(d) for d in rows])
    top = grown([trees[s][1][-1][0] for s in order])
    for k, s in enumerate(order):
        rows, levels = trees[s]
        for at, d in enumerate(rows):
            tampered = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 5 == 0
            below, value = up(levels, at, leaf_of((*d[:4], low(d[4]))) if tampered else levels[0][at])
            above, value = up(top, k, value)
            yield (d[0], levels[0][at], levels[-1][0], top[-1][0], digest(*below, *above), value, value == top[-1][0])


def test_op13(spark, tables):  # noqa: F811
    docs = [tuple(r[c] for c in merkle.FIELDS) for r in spark.read.parquet(f"{tables[0]}/documents.parquet").collect()]
    got = sorted(tuple(r.values()) for r in rows_of(spark, tables, "op13_merkle"))
    assert got == sorted(brute_merkle(docs))


@pytest.mark.parametrize("size", [0, 1, 2, 16, 17, 256, 257, 4097])
def test_trees_of_any_size(spark, tmp_path, size):
    """One hot source, many of one or two rows, null among them."""
    rng = random.Random(size)
    docs = [(i, "hot" if i % 3 else rng.choice([None, "", "é", *map(str, range(300))]), None if i % 7 == 0 else "en", i, rng.choice([None, "", "Text A", "é B", "plain"])) for i in range(size)]
    spark.createDataFrame(docs, "doc_id long, source string, lang string, n_chars long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op13_merkle(spark, str(tmp_path)).collect()))
    assert got == sorted(brute_merkle(docs))
    assert size < 256 or 0 < sum(not r[-1] for r in got) < size / 5


def test_manifest_of_odd_rows(spark):
    d = docs_of(spark, ROWS)
    out = merkle.verify(merkle.manifest(d)).collect()
    want = {r[0]: r for r in brute_merkle([(r[0], r[3], r[2], r[4], r[1]) for r in ROWS])}
    assert len(out) == len(ROWS) and all(r["verified"] for r in out)
    assert sorted((r["leaf"], r["subroot"], r["root"]) for r in out) == sorted(x[1:4] for x in brute_merkle([(r[0], r[3], r[2], r[4], r[1]) for r in ROWS]))
    assert {r["root"] for r in out} == {want[1][3]}
    empty = merkle.manifest(docs_of(spark, []))
    assert empty.root is None and merkle.verify(empty).count() == 0


def test_one_changed_row_is_found(spark):
    rows = [row(i, f"text {i}", "ab"[i % 2]) for i in range(40)]
    other = merkle.leaf(text=queries.F.when(queries.F.col("doc_id") == 17, "text 71").otherwise(queries.F.col("text")))
    out = merkle.verify(merkle.manifest(docs_of(spark, rows), other))
    assert [r["doc_id"] for r in out.filter("not verified").collect()] == [17]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_gives_the_same_rows(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df, sql = queries.queries()[name](spark, sf_dir), con.sql(queries.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(sql.columns)
    plain = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    want = sorted(tuple(plain(r[sql.columns.index(c)]) for c in cols) for r in sql.fetchall())
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == want
