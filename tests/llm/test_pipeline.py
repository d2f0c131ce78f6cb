"""The corpus pipeline, stage by stage, on the small tables."""

import hashlib
import re

import numpy as np

import corpus_pipeline
from earshot.llm import encode, queries
from earshot.llm.session import materialize


def test_stages(spark):
    at = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns, held = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = materialize(stage(spark, docs, at), name)
        rows = docs.collect()
        held[name] = rows
        if name != "encode":
            assert docs.columns == columns
            assert all(r["text"] == before[r["doc_id"]]["text"] for r in rows)
        if name in ("exact_dedup", "near_dedup"):
            assert len({r["doc_id"] for r in rows}) == len(rows)
        if name == "exact_dedup":
            norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
            first: dict[str, int] = {}
            for i in sorted(before):
                first.setdefault(norm(before[i]["text"]), i)
            assert {r["doc_id"] for r in rows} == set(first.values())
        if name == "encode":
            lib = encode.rank_library(queries.tokenizer_file("byte_bpe_multi_50k.tiktoken"), queries.byte_pattern())
            for r in rows:
                text = before[r["doc_id"]]["text"]
                assert np.frombuffer(r["ids"], "<u4").tolist() == lib.encode_ordinary(text)
                assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in held["quality"]}
    assert np.mean([i in kept for i, q in labels.items() if q == 1]) > 0.97
    assert len(held["encode"]) == len(held["mix"])
