"""Embedding ranking, checks, and spans of frame scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.acoustics import round_to


#: Prompts of a block, whose matrix takes a few megabytes, and similarities that are held at a time.
PROMPTS, CELLS = 16_384, 1 << 21
#: More than what sums of products in another order differ by, for vectors of unit length and up to some thousand components.
SLACK = 1e-9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def _matrix(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of ``width`` components as rows, and which ones are such: no nulls, all finite."""
    size = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    out, good = np.zeros((len(vectors), width)), size == width
    flat = vectors.filter(pa.array(good)).flatten()
    out[good] = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(int(good.sum()), width)
    good &= np.isfinite(out).all(axis=1)
    out[~good] = 0.0
    return out, good


def _in_turn(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of products of rows, component after component, so that equal vectors have equal sums wherever they lie."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def nearest(x: np.ndarray, y: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of x, rows of y and their cosines for the ``top`` nearest rows of y, which are in order of preference at ties; x comes in parts of ``CELLS`` cosines.

    Products of matrices find the rows that may be among them, and only these are summed in turn.
    """
    top = min(top, len(y))
    lengths = [np.maximum(np.sqrt(_in_turn(v, v)), 1e-12) for v in (x, y)]
    unit = [v / n[:, None] for v, n in zip((x, y), lengths)]
    parts = []
    for k in range(0, len(x) if top else 0, step := max(1, CELLS // max(len(y), 1))):
        about = unit[0][k : k + step] @ unit[1].T
        least = np.partition(about, len(y) - top, axis=1)[:, len(y) - top, None] - SLACK
        i, j = np.nonzero(about >= least)
        cosine = np.empty(len(i))
        for a in range(0, len(i), 1 << 16):
            one, other = i[a : a + (1 << 16)] + k, j[a : a + (1 << 16)]
            cosine[a : a + (1 << 16)] = _in_turn(x[one], y[other]) / (lengths[0][one] * lengths[1][other])
        order = np.lexsort((j, -cosine, i))
        i, j, cosine = i[order], j[order], cosine[order]
        first = np.searchsorted(i, np.arange(len(about)))
        keep = np.arange(len(i)) - first[i] < top
        parts.append((i[keep] + k, j[keep], cosine[keep]))
    return tuple(np.concatenate(v) for v in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _best(batches: Iterator[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
    """(vec_id, _row, id, cosine) of sorted rows: of each task first its block of prompts in order of their ids, then clips batch by batch, so one block and one batch are held."""
    task, ids, held = None, [], []
    ready: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def answer(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        clips, known = rows.column("embedding"), pa.concat_arrays(ids)
        sizes = pc.fill_null(pc.list_value_length(clips), -1).to_numpy(zero_copy_only=False)
        found = [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        for width in np.unique(sizes).tolist():
            here = np.flatnonzero(sizes == width)
            if width not in ready:
                ready[width] = _matrix(pa.concat_arrays(held), max(width, 0))
            (x, good), (y, fit) = _matrix(clips.take(pa.array(here)), max(width, 0)), ready[width]
            some, at = here[good], np.flatnonzero(fit)
            i, j, cosine = nearest(x[good], y[at], top)
            full = min(top, len(known))
            # What has no cosine comes after all that have one, by its id.
            lacks = np.where(good, np.maximum(full - len(at), 0), full)
            tail = np.repeat(np.arange(len(here)), lacks)
            turn = np.arange(len(tail)) - np.repeat(np.cumsum(lacks) - lacks, lacks)
            rest = np.where(good[tail], (np.flatnonzero(~fit)[np.minimum(turn, max((~fit).sum() - 1, 0))] if (~fit).any() else 0), turn)
            found = [np.concatenate(v) for v in zip(found, (some[i], at[j], cosine), (here[tail], rest, np.full(len(tail), np.nan)))]
        i, j, cosine = found
        yield pa.RecordBatch.from_arrays([*[rows.column(c).take(pa.array(i)) for c in ("vec_id", "_row")], known.take(pa.array(j)), pa.array(cosine, mask=np.isnan(cosine))], names=["vec_id", "_row", "id", "cosine"])

    for batch in batches:
        tasks, clip = batch.column("_task").to_numpy(), batch.column("_clip").to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((np.diff(tasks) != 0) | (np.diff(clip.astype(np.int8)) != 0)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(tasks)]):
            if a == b:
                continue
            if tasks[a] != task:
                task, ids, held = tasks[a], [], []
                ready.clear()
            part = batch.slice(a, b - a)
            if clip[a]:
                if ids:
                    yield from answer(part)
            else:
                ids.append(part.column("id"))
                held.append(part.column("embedding"))


def zero_shot(clips: DataFrame, prompts: DataFrame, top: int = 3) -> DataFrame:
    """The ``top`` prompts nearest to each clip (vec_id, embedding), by id at ties; prompts are (prompt_id, embedding), any number of them.

    Prompts are dealt into blocks of about ``PROMPTS``, and each block goes to
    some tasks, over which the clips are dealt.  A task multiplies matrices, and a
    last step ranks what a clip has of several blocks.  Of prompts with one and the
    same vector only the first ``top`` can be among the nearest.  Pairs without a
    cosine (vectors that are null, of another length or not finite) come last.
    """
    spark = clips.sparkSession
    number = F.row_number().over(Window.partitionBy("embedding").orderBy("prompt_id"))
    firsts = prompts.select("prompt_id", F.col("embedding").cast("array<double>").alias("embedding")).withColumn("_n", number).filter(F.col("_n") <= top)
    blocks, parts = max(1, -(-firsts.count() // PROMPTS)), 4 * spark.sparkContext.defaultParallelism
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block, part = F.pmod(F.xxhash64("prompt_id"), F.lit(blocks)), F.pmod(F.xxhash64("_row"), F.lit(parts))
    kind = prompts.schema["prompt_id"].dataType
    no = lambda t: F.lit(None).cast(t)
    shown = firsts.select(F.col("prompt_id").alias("id"), "embedding", block.alias("_b"), every(parts).alias("_p"))
    shown = shown.select((F.col("_b") * parts + F.col("_p")).cast("long").alias("_task"), F.lit(False).alias("_clip"), "id", no(clips.schema["vec_id"].dataType).alias("vec_id"), no("long").alias("_row"), "embedding")
    rows = clips.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).withColumn("_row", F.monotonically_increasing_id())
    rows = rows.withColumn("_p", part).withColumn("_b", every(blocks))
    rows = rows.select((F.col("_b") * parts + F.col("_p")).cast("long").alias("_task"), F.lit(True).alias("_clip"), no(kind).alias("id"), "vec_id", "_row", "embedding")
    met = shown.union(rows).repartition(blocks * parts, "_task").sortWithinPartitions("_task", "_clip", "id")
    types = [f"{c} {t.simpleString()}" for c, t in (("vec_id", clips.schema["vec_id"].dataType), ("_row", T.LongType()), ("id", kind), ("cosine", T.DoubleType()))]
    found = met.mapInArrow(lambda batches: _best(batches, top), ", ".join(types))
    order = F.array_sort(F.collect_list(F.struct(F.col("cosine").isNull().alias("none"), (-F.col("cosine")).alias("s"), "id")))
    best = found.groupBy("_row", "vec_id").agg(F.slice(order, 1, top).alias("_best"))  # ``top`` of each block at most
    out = best.select("vec_id", F.posexplode("_best").alias("pos", "r"))
    return out.select("vec_id", (F.col("pos") + 1).alias("rank"), F.col("r.id").alias("prompt_id"), (-F.col("r.s")).alias("similarity"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 - F.col("r.s")) / 2)).alias("confidence"))


def quality(vectors: DataFrame, dim: int) -> DataFrame:
    """One row: how many vectors there are, of the wrong length, with null or non-finite parts, and not of unit length."""
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.agg(F.count("*").alias("vectors"), F.count_if(e.isNull() | (F.size(e) != dim)).alias("wrong_length"), F.count_if(F.coalesce(bad, F.lit(True))).alias("not_finite"), F.count_if(F.abs(norm(e) - 1.0) > 1e-3).alias("not_unit"))


def frame_spans(frames: DataFrame, threshold: float = 0.5, fps: float = 50.0, min_span_s: float = 0.02) -> DataFrame:
    """Runs of frames (clip, scores array) at the threshold or above: t0_s, t1_s and the highest score."""
    return frame_row_spans(frames.select("clip", F.posexplode("scores").alias("place", "score")), threshold, fps, min_span_s)


def frame_row_spans(frames: DataFrame, threshold: float = 0.5, fps: float = 50.0, min_span_s: float = 0.02) -> DataFrame:
    """``frame_spans`` of frames that are rows (clip, place from 0, score), in order of their places: no array of a clip's scores is made."""
    above = frames.filter(F.col("score") >= threshold)
    run = F.col("place") - F.row_number().over(Window.partitionBy("clip").orderBy("place"))  # the same within a run
    spans = above.select("clip", "place", "score", run.alias("run")).groupBy("clip", "run").agg(F.min("place").alias("a"), (F.max("place") + 1).alias("b"), F.max("score").alias("m"))
    least = max(1, round(min_span_s * fps))
    return spans.filter(F.col("b") - F.col("a") >= least).select("clip", round_to(F.col("a") / fps, 3).alias("t0_s"), round_to(F.col("b") / fps, 3).alias("t1_s"), round_to(F.col("m"), 4).alias("confidence"))
