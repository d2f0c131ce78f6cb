"""From raw documents to training tokens in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; on a cluster it
is written as Parquet and read again for the next.  All but the last return the
columns of ``documents``, whatever else these are called.

Defined cases, in all stages: a null text counts as empty; texts of any length
are read whole; an empty table stays empty; rows that repeat a doc_id are judged
each by its own text; other columns may be null and are handed on untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.llm import bytebpe, exact, minhash, mixing, quality
from earshot.llm.queries import QUALITY, byte_pattern, held_out, tokenizer_file
from earshot.llm.session import materialize

#: Near copies share at least this part of their five-word shingles; op5 has its own figure.
NEAR_PERCENT = 80


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; a document without text, or without doc_id, is scored like any other, and without labels all stay."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out())
    return quality.keep(docs, model, QUALITY)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays; rows that repeat this doc_id with that text all stay, and so do rows without doc_id."""
    return exact.deduplicate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, linked from a similarity of 0.8 on; rows without words or without doc_id stay."""
    return minhash.deduplicate(docs, NEAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix takes it; a null source is a source of its own, and of a source without words nothing is taken."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, with digests of them and of the bytes they decode to; a document without text has none."""
    out = bytebpe.encode(docs, tokenizer_file("byte_bpe_multi_50k.tiktoken"), byte_pattern())
    return out.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality_filter),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix", mix_sources),
    ("encode", encode),
]

#: A fitted model and byte-pair encoding have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
