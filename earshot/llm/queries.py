"""The registered queries of this subpackage and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bytebpe, exact, lattice, merkle, minhash, mixing, pii, piece, quality, suffix, tokencount, tokenfile

TOKEN_LIMIT = 2048
END_ID = 2
QUALITY = 0.3


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def held_out() -> Column:
    """Rows kept from training."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for each document."""
    docs = _docs(spark, sf_dir)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out())
    out = quality.score(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= QUALITY).cast("int").alias("predicted"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    mixed = mixing.with_copies(_docs(spark, sf_dir).select("doc_id", "text", "source"))
    return mixed.select("doc_id", F.col("_mix_size").alias("size"), F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"), (F.col("_mix_size") * F.col("_mix_copies")).alias("taken"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (
  SELECT *, CAST(CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS weight, 3 * source_size AS cap FROM s),
o AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS whole,
    CAST(coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
    CAST(sum(weight) OVER (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS open_weight,
    row_number() OVER (ORDER BY cap::DOUBLE / weight, rank) AS place FROM w),
f AS (
  SELECT before, open_weight FROM o WHERE cap::DOUBLE >= (whole - before)::DOUBLE * weight / open_weight::DOUBLE ORDER BY place LIMIT 1),
t AS (
  SELECT o.source, o.source_size,
    CASE WHEN cap::DOUBLE < (whole - f.before)::DOUBLE * weight / f.open_weight::DOUBLE THEN cap::DOUBLE
         ELSE (whole - f.before)::DOUBLE * weight / f.open_weight::DOUBLE END AS target FROM o, f),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0e0 END AS rate,
    CAST('0x' || substr(md5('mix:' || CAST(d.doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296e0 AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of each document and of the bytes they decode to."""
    out = bytebpe.encode(_docs(spark, sf_dir), tokenizer_file("byte_bpe_multi_50k.tiktoken"), byte_pattern())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data of each document: counts, a digest of the base kinds, and all."""
    found = pii.spans(_docs(spark, sf_dir).select("doc_id", "text"))
    kinds = [pii.count_of(F.col("spans"), k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    return found.select("doc_id", *kinds, F.sha2(pii.joined(pii.base_only(F.col("spans"))), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of near copies of each document."""
    return minhash.groups(_docs(spark, sf_dir)).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct([array_to_string(words[i:i + 4], ' ') FOR i IN range(1, len(words) - 3)]) END AS shingles FROM w),
every AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
e AS (SELECT * FROM every SEMI JOIN (SELECT shingle FROM every GROUP BY shingle HAVING count(*) > 1) USING (shingle)),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id, doc_id AS other FROM s UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.other = links.a)
SELECT doc_id, CAST(any_value(len(shingles)) AS BIGINT) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept FROM s JOIN reach USING (doc_id) GROUP BY doc_id
"""


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and group of each embedding."""
    return lattice.linked(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


OP6_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT *, sqrt(list_sum([x * x FOR x IN e])) AS norm FROM v WHERE len(e) > 0 AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND a.norm > 0 AND b.norm > 0
  WHERE list_dot_product(a.e, b.e) / a.norm / b.norm >= 0.95),
reach AS (SELECT vec_id, vec_id AS other FROM v UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON reach.other = links.a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, min(other) AS component_id, vec_id = min(other) AS kept FROM reach GROUP BY vec_id
"""


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of equal texts of each document."""
    g = exact.groups(_docs(spark, sf_dir))
    return g.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256 FROM d
"""


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of each document."""
    out = tokencount.token_counts(_docs(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document lies in the written token files, and a checksum of what is read back."""
    at = tokenfile.write_ids(_docs(spark, sf_dir), tokenizer_file("word_bpe_49k.json"), END_ID)
    return tokenfile.read_ids(spark, at).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without the strings of 50 bytes that an earlier one has."""
    return suffix.remove_repeats(_docs(spark, sf_dir), keep_text=False).drop("kept")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes, alone and in every order, for each source."""
    return audit.audit(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
b AS (
  SELECT d.doc_id, part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
    [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
     regexp_matches(text, '[#$%&*|]'), coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false)] AS fails
  FROM d LEFT JOIN (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id),
f AS (
  SELECT part, good, toxic, list_sum([CASE WHEN fails[i] THEN 1 << (i - 1) ELSE 0 END FOR i IN range(1, 6)])::INT AS mask, count(*) AS n FROM b GROUP BY ALL),
o AS (
  SELECT a.i || b.i || c.i || d.i || e.i AS filter_order FROM (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS i) a, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS i) b,
    (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS i) c, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS i) d, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS i) e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (
  SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS own,
    coalesce(list_sum([1 << (ascii(filter_order[j]) - 65) FOR j IN range(1, step)]), 0)::INT AS prior FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (
  SELECT part, filter_order, step, own, sum(n) FILTER (mask & (prior | own) = 0) AS kept, sum(n) FILTER (mask & prior = 0 AND mask & own > 0) AS removed,
    sum(n) FILTER (mask & prior > 0 AND mask & own > 0) AS redundant, sum(n) FILTER (mask = own) AS unique_fails,
    sum(n) FILTER (mask & prior = 0 AND mask & own > 0 AND good) AS good_lost, sum(n) FILTER (mask & prior = 0 AND mask & own > 0 AND toxic) AS toxic_lost
  FROM f, s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, own), 0) AS BIGINT) AS shapley FROM r
"""


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of each document, begin and end included, and of the text they decode to."""
    out = piece.encode(_docs(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's leaf, subroot, proof and the root it folds to; of every fifth after its text was tampered with."""
    tampered = merkle.leaf(text=merkle.lower_case(F.col("text")))
    altered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, tampered)
    out = merkle.verify(merkle.manifest(_docs(spark, sf_dir), altered))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"), "folded_root", "verified")


OP13_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('s' || source, '-') AS tree, text,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') ||
    coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS head,
    list_reduce(list_prepend(4294967295::BIGINT, flatten([[ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(doc_id::VARCHAR, '')])),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS crc
  FROM documents),
l AS (
  SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 5 = 0 THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS altered FROM d),
p AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM l),
t AS (
  SELECT 0 AS level, tree, pos, n, leaf AS hash, NULL::VARCHAR AS preimage FROM p
  UNION ALL
  SELECT level + 1, tree, pos // 16, (n + 15) // 16, sha256(string_agg(hash, '' ORDER BY pos)), string_agg(hash, '' ORDER BY pos) FROM t WHERE n > 1 GROUP BY level, tree, pos // 16, n),
subroots AS (
  SELECT tree, hash, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (
  SELECT 0 AS level, pos, n, hash, NULL::VARCHAR AS preimage FROM subroots
  UNION ALL
  SELECT level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(hash, '' ORDER BY pos)), string_agg(hash, '' ORDER BY pos) FROM u WHERE n > 1 GROUP BY level, pos // 16, n),
low AS (
  SELECT doc_id, tree, pos AS own, 0 AS level, pos, n, '' AS proof, coalesce(altered, leaf) AS fold FROM p
  UNION ALL
  SELECT doc_id, low.tree, own, low.level + 1, t.pos, t.n, proof || substr(preimage, 1, 64 * (low.pos % 16)::INT) || substr(preimage, 64 * (low.pos % 16)::INT + 65),
    sha256(substr(preimage, 1, 64 * (low.pos % 16)::INT) || fold || substr(preimage, 64 * (low.pos % 16)::INT + 65))
  FROM low JOIN t ON low.n > 1 AND t.tree = low.tree AND t.level = low.level + 1 AND t.pos = low.pos // 16),
high AS (
  SELECT doc_id, low.tree, own, 0 AS level, s.pos, s.n, proof, fold, s.hash AS subroot FROM low JOIN subroots s ON low.n = 1 AND s.tree = low.tree
  UNION ALL
  SELECT doc_id, high.tree, own, high.level + 1, u.pos, u.n, proof || substr(preimage, 1, 64 * (high.pos % 16)::INT) || substr(preimage, 64 * (high.pos % 16)::INT + 65),
    sha256(substr(preimage, 1, 64 * (high.pos % 16)::INT) || fold || substr(preimage, 64 * (high.pos % 16)::INT + 65)), subroot
  FROM high JOIN u ON high.n > 1 AND u.level = high.level + 1 AND u.pos = high.pos // 16)
SELECT h.doc_id, p.leaf, h.subroot, r.hash AS root, sha256(h.proof) AS proof_sha256, h.fold AS folded_root, h.fold = r.hash AS verified
FROM high h JOIN p ON p.tree = h.tree AND p.pos = h.own, (SELECT hash FROM u WHERE n = 1) r WHERE h.n = 1
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_mixing": op2_mixing,
        "op3_byte_bpe": op3_byte_bpe,
        "op4_pii": op4_pii,
        "op5_minhash_dedup": op5_minhash_dedup,
        "op6_embedding_dedup": op6_embedding_dedup,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_token_counts": op8_token_counts,
        "op9_token_files": op9_token_files,
        "op10_suffix_dedup": op10_suffix_dedup,
        "op11_filter_audit": op11_filter_audit,
        "op12_sentencepiece": op12_sentencepiece,
        "op13_merkle": op13_merkle,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": OP2_SQL, "op5_minhash_dedup": OP5_SQL, "op6_embedding_dedup": OP6_SQL, "op7_exact_dedup": OP7_SQL, "op11_filter_audit": OP11_SQL, "op13_merkle": OP13_SQL}
