"""Where models plug in: batch scorers, attention masks, query slots, checks of stored embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow.fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.labels import WindowConfig, load_prompts, prompts_hash
from . import dsp
from .embed import zero_shot

#: Query slots of the open-vocabulary detector.
SLOTS = 16


def score(rows: DataFrame, load: Callable[[], Callable[[np.ndarray], list[tuple[str, float]]]], top: int = 3) -> DataFrame:
    """(chunk_id, predictions) of rows (chunk_id, pcm); each Python worker loads the model once.

    Rows that are gated should be filtered out before: a filter isn't pushed
    through a Python function.  A row whose inference fails is dropped.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            out = []
            for i, x in zip(pdf["chunk_id"], pdf["pcm"]):
                try:
                    found = sorted(model(np.asarray(x, np.float32)), key=lambda p: -p[1])[:top]
                except (ValueError, RuntimeError):
                    continue
                out.append((i, [{"label": a, "confidence": float(b)} for a, b in found]))
            yield pd.DataFrame(out, columns=["chunk_id", "predictions"])

    return rows.select("chunk_id", "pcm").mapInPandas(run, "chunk_id long, predictions array<struct<label:string,confidence:double>>")


def attention_mask(base: int, queries: int, slots: int = SLOTS) -> np.ndarray:
    """Which column each row may attend to: the base queries and itself; empty slots only themselves."""
    n = base + slots
    out = np.zeros((n, n), bool)
    out[: base + queries, :base] = True
    np.fill_diagonal(out, True)
    return out


def pad_queries(queries: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Queries with zero rows up to the number of slots; more than that is an error."""
    if len(queries) > slots:
        raise ValueError(f"{len(queries)} queries for {slots} slots")
    return np.concatenate((queries, np.zeros((slots - len(queries), queries.shape[1]), queries.dtype)))


def compatible(stored: dict[str, Any], model: str, dim: int) -> bool:
    """Whether stored embeddings (model_name, embed_dim) fit a model."""
    return stored.get("model_name") == model and stored.get("embed_dim") == dim


def in_sync(stored: dict[str, Any], model: str, dim: int, prompts: str, labels: list[str]) -> bool:
    """Whether they are also those of these prompts, by hash and in order."""
    return compatible(stored, model, dim) and stored.get("prompts_hash") == prompts and list(stored.get("labels", [])) == labels


def load_embeddings(spark: SparkSession, path: str, dim: int) -> tuple[DataFrame, dict[str, Any]]:
    """Stored prompt embeddings and what they were made by, checked for their length."""
    rows = spark.read.parquet(path)
    made = rows.groupBy("model_name", "embed_dim", "prompts_hash").agg(F.count_if(F.col("embedding").isNull() | (F.size("embedding") != dim)).alias("bad")).limit(2).collect()
    if len(made) != 1 or made[0]["bad"]:
        raise ValueError("stored embeddings are of several makes, or of another length")
    return rows.select("label", "prompt", "embedding"), {k: made[0][k] for k in ("model_name", "embed_dim", "prompts_hash")}


def encode_prompts(prompts: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], dim: int, batch: int = 64) -> DataFrame:
    """(label, prompt, embedding) of prompts (label, prompt) by a text encoder that each worker loads once; vectors get unit length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load()
        for pdf in batches:
            for k in range(0, len(pdf), batch):
                some = pdf.iloc[k : k + batch]
                x = np.asarray(encode(some["prompt"].tolist()), np.float64)
                if x.shape != (len(some), dim):
                    raise ValueError(f"the encoder gave {x.shape} for {len(some)} prompts of {dim} components")
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                yield pd.DataFrame({"label": some["label"], "prompt": some["prompt"], "embedding": list(x.astype(np.float32))})

    return prompts.select("label", "prompt").mapInPandas(run, "label string, prompt string, embedding array<float>")


def embed_audio(pcm: DataFrame, load: Callable[[], Callable[[np.ndarray], np.ndarray]], chain: str = "caption") -> DataFrame:
    """(vec_id, embedding) of chunks (chunk_id, pcm): features by one of ``dsp.CHAINS``, then an audio encoder that each worker loads once; unit length."""
    make, _ = dsp.CHAINS[chain]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load()
        for pdf in batches:
            found = [np.asarray(encode(make(np.asarray(x, float))), np.float64) for x in pdf["pcm"]]
            yield pd.DataFrame({"vec_id": pdf["chunk_id"], "embedding": [(v / max(np.linalg.norm(v), 1e-12)).astype(np.float32) for v in found]})

    return pcm.select("chunk_id", "pcm").mapInPandas(run, "vec_id long, embedding array<float>")


def detect(mels: DataFrame, load: Callable[[], Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]], labels: list[str], shape: tuple[int, int] = (1001, 64)) -> DataFrame:
    """(chunk_id, label, clip_confidence, scores) of features (chunk_id, features): a detector gives (queries, frames) and (queries,) scores; padding rows go, the surest labels come first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            for i, x in zip(pdf["chunk_id"], pdf["features"]):
                strong, weak = model(np.asarray(x, np.float32).reshape(shape))
                order = np.argsort(-weak[: len(labels)], kind="stable")
                yield pd.DataFrame({"chunk_id": i, "label": [labels[k] for k in order], "clip_confidence": weak[order].astype(float), "scores": [strong[k].astype(float) for k in order]})

    return mels.select("chunk_id", "features").mapInPandas(run, "chunk_id long, label string, clip_confidence double, scores array<double>")


def runs(scores: np.ndarray, threshold: float, fps: float, min_span_s: float) -> list[dict[str, float]]:
    """Stretches of frames at the threshold or above that last long enough, with their bounds in seconds and highest score."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], (np.asarray(scores) >= threshold).view(np.int8), [0]))))
    least = max(1, round(min_span_s * fps)) if min_span_s > 0 else 1
    return [{"t0_s": round(a / fps, 3), "t1_s": round(b / fps, 3), "confidence": round(float(scores[a:b].max()), 4)} for a, b in edge.reshape(-1, 2).tolist() if b - a >= least]


SPANS = "array<struct<label:string,clip_confidence:double,spans:array<struct<t0_s:double,t1_s:double,confidence:double>>>>"


class NotReady(RuntimeError):
    """Stored embeddings or queries that can't be used with these prompts."""


@dataclass(frozen=True)
class PromptModel:
    """Prompts, what they are stored as, and the checks between them: what both classifiers load before they predict.

    ``queries`` is where a detector's base queries are stored (index, embedding),
    None for a classifier that has none; ``most`` bounds the prompts.
    """

    prompts_path: str
    embeddings_path: str
    name: str
    dim: int
    most: int | None = None
    queries: str | None = None

    def problem(self, spark: SparkSession) -> str | None:
        """Why the model can't predict, or None."""
        try:
            self.load(spark)
        except (NotReady, FileNotFoundError, ValueError) as e:
            return str(e)
        return None

    def load(self, spark: SparkSession) -> tuple[list[str], DataFrame, np.ndarray | None]:
        """Labels in their order, their embeddings (label, prompt, embedding), and the base queries; read anew each time, so changed files count."""
        pairs = load_prompts(self.prompts_path, self.most)
        rows, made = _stored(spark, self.embeddings_path, self.dim)
        if not compatible(made, self.name, self.dim):
            raise NotReady(f"embeddings of {made['model_name']} with {made['embed_dim']} components; {self.name} needs {self.dim}: rebuild them")
        if made["prompts_hash"] != prompts_hash(pairs):
            raise NotReady("embeddings are out of sync with the prompts: rebuild them")
        labels, known = [label for label, _ in pairs], {r[0] for r in rows.select("label").limit(len(pairs) + 1).collect()}
        if known != set(labels):
            raise NotReady("labels of the embeddings aren't those of the prompts")
        return labels, rows, None if self.queries is None else base_queries(spark, self.queries, self.dim)


#: Base queries that a detector may have.
MOST_QUERIES = 4096


def base_queries(spark: SparkSession, path: str, dim: int) -> np.ndarray:
    """A detector's base queries (index, embedding) as a matrix, in order."""
    rows = _table(spark, path).select("index", "embedding").orderBy("index").limit(MOST_QUERIES + 1).collect()
    if not rows or len(rows) > MOST_QUERIES or any(r["embedding"] is None or len(r["embedding"]) != dim for r in rows):
        raise NotReady(f"base queries must be 1 to {MOST_QUERIES} rows of {dim} components")
    return np.array([r["embedding"] for r in rows], np.float32)


def _table(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        raise FileNotFoundError(f"nothing is stored at {path}: rebuild it") from e


def _stored(spark: SparkSession, path: str, dim: int) -> tuple[DataFrame, dict[str, Any]]:
    _table(spark, path)
    try:
        return load_embeddings(spark, path, dim)
    except ValueError as e:
        raise NotReady(f"{e}: rebuild them") from e


def captions(model: PromptModel, pcm: DataFrame, load: Callable, top: int = 3) -> DataFrame:
    """The labels nearest to each chunk (chunk_id, pcm) by the audio encoder that ``load`` gives: vec_id, rank, label, confidence."""
    labels, rows, _ = model.load(pcm.sparkSession)
    place = F.create_map(*[x for k, label in enumerate(labels) for x in (F.lit(label), F.lit(k))])
    prompts = rows.select(F.element_at(place, F.col("label")).alias("prompt_id"), "embedding")
    named = F.element_at(F.array(*map(F.lit, labels)), F.col("prompt_id") + 1)
    return zero_shot(embed_audio(pcm, load), prompts, top).select("vec_id", "rank", named.alias("label"), "confidence")


def detections(model: PromptModel, pcm: DataFrame, load: Callable, window: WindowConfig = WindowConfig()) -> DataFrame:
    """What the detector hears in each window (chunk_id, pcm): top_label, top_confidence, and for each label its confidence and spans, the surest first.

    ``load`` gives a function from features, queries and mask to scores by query
    and frame and by query; each worker loads it once, queries and mask once too.
    """
    labels, rows, base = model.load(pcm.sparkSession)
    if base is None:
        raise NotReady("a detector needs base queries")
    stored = {r["label"]: r["embedding"] for r in rows.limit(SLOTS + 1).collect()}
    own = np.array([stored[x] for x in labels], np.float32)
    query, mask, first = np.concatenate((base, pad_queries(own))), attention_mask(len(base), len(own)), len(base)
    w = window.normalised()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = load()
        for pdf in batches:
            out = []
            for i, x in zip(pdf["chunk_id"], pdf["pcm"]):
                strong, weak = (np.asarray(v, np.float32) for v in predict(dsp.detector_mel(np.asarray(x, float)), query, mask))
                strong, weak = (v[0] if v.ndim == n else v for v, n in ((strong, 3), (weak, 2)))  # a batch of one
                found = [{"label": label, "clip_confidence": round(float(weak[first + k]), 4), "spans": runs(strong[first + k], w.frame_threshold, w.frames_per_second, w.min_span_s)} for k, label in enumerate(labels)]
                found.sort(key=lambda r: -r["clip_confidence"])
                out.append((i, found[0]["label"], found[0]["clip_confidence"], found))
            yield pd.DataFrame(out, columns=["chunk_id", "top_label", "top_confidence", "labels"])

    return pcm.select("chunk_id", "pcm").mapInPandas(run, f"chunk_id long, top_label string, top_confidence double, labels {SPANS}")


def _heads(spark: SparkSession, path: str) -> DataFrame:
    """(name, length, head) of the files of a folder: their first MiB, read by executors; the rest of a model isn't touched."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            heads = []
            for at in pdf["path"]:
                store, own = pyarrow.fs.FileSystem.from_uri(at) if ":" in at else (pyarrow.fs.LocalFileSystem(), at)
                with store.open_input_file(own) as f:
                    heads.append(f.read_at(min(1 << 20, f.size()), 0))
            yield pd.DataFrame({"name": [at.rsplit("/", 1)[-1] for at in pdf["path"]], "length": pdf["length"], "head": heads})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.mapInPandas(run, "name string, length long, head binary")


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(name, fingerprint) of model files: twelve hex digits of the SHA-256 of the first MiB and the size."""
    digest = F.sha2(F.concat("head", F.col("length").cast("string").cast("binary")), 256)
    return _heads(spark, path).select("name", F.substring(digest, 1, 12).alias("fingerprint"))


def assets(spark: SparkSession, path: str, needed: list[str]) -> dict[str, Any]:
    """Whether a model's files are all there and not empty: ready, the missing ones, and sizes of those that are there."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), "length")
        found = {r["name"]: r["length"] for r in files.filter(F.col("name").isin(*needed)).collect()}
    except AnalysisException:
        found = {}
    missing = [n for n in needed if not found.get(n)]
    return {"ready": not missing, "missing": missing, "bytes": {n: found[n] for n in needed if n in found}}


def rebuild(prompts: DataFrame, path: str, stored: dict[str, Any] | None, load: Callable, model: str, dim: int, digest: str, labels: list[str]) -> bool:
    """Encode and save prompts again unless what is stored is in sync with them; tells whether it did."""
    if stored is not None and in_sync(stored, model, dim, digest, labels):
        return False
    save_embeddings(encode_prompts(prompts, load, dim), path, model, dim, digest)
    return True


def save_embeddings(rows: DataFrame, path: str, model: str, dim: int, prompts: str) -> None:
    """Prompt embeddings (label, prompt, embedding) as Parquet, with what they were made by."""
    bad = rows.filter(F.col("embedding").isNull() | (F.size("embedding") != dim)).limit(1).count()
    if bad:
        raise ValueError(f"an embedding hasn't {dim} components")
    rows.withColumns({"model_name": F.lit(model), "embed_dim": F.lit(dim), "prompts_hash": F.lit(prompts)}).write.mode("overwrite").parquet(path)
