"""Quality scores by Naive Bayes support vectors.

Every text becomes a set of hashed n-grams: bytes in threes, words, pairs of
words, and pairs that repeat a word.  Class counts of all labelled training
rows give each n-gram a log-count ratio; indicators scaled by the ratios, at
unit length, feed a linear hinge-loss model fitted by dual coordinate descent
on a bounded sample, and a logistic curve turns its margin into a score.

Bound: the hinge-loss model and the curve are fitted on at most ``SAMPLE``
labelled rows, those with the smallest hashes of their doc_id.  All counts
cover all labelled training rows.

Defined cases: null and empty texts have no n-grams and get the score of the
intercept alone; texts of any length are read whole; a label row with a null
label is not used, and of several for one doc_id the largest label counts; rows
that repeat a doc_id each get a score; without labelled rows of both classes
every score is 0.5; an empty table gives an empty result; other columns are not
read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import documents, join_even, materialize, packed, small_batches
from .vectext import U64, Words, blocks, mix

BITS = 18
SAMPLE = 6000
#: Smoothing of the counts, cost of the hinge loss, passes of the descent.
SMOOTH, COST, PASSES = 1.0, 1.0, 12
#: Features whose counts are summed in one task.
_RANGE = 1 << 14
#: Partitions' counts that one task sums.
FAN_IN = 64


def features(block: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-grams of each text in turn, and where each text's begin."""
    words = Words(block)
    data = words.data.astype(np.uint32)
    n = len(data)
    mask = U64((1 << BITS) - 1)
    three = (data[: n - 2] | data[1 : n - 1] << 8 | data[2:] << 16) if n > 2 else data[:0]
    three = ((three * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64)
    h = words.hashes()
    one = (mix(h + U64(1)) & mask).astype(np.int64)
    same = (h[1:] == h[:-1]) if len(h) else np.zeros(0, bool)
    pair = np.where(same, U64(7), h[:-1] * U64(3) + h[1:]) if len(h) else h
    for k, longer in enumerate((3, 5)):  # runs of three and of five words that are all the same
        run = np.flatnonzero(np.convolve(same, np.ones(longer - 1, np.int8), "valid") == longer - 1) if len(same) >= longer - 1 else []
        pair[run] = U64(8 + k)
    two = (mix(pair + U64(2)) & mask).astype(np.int64)
    seen = np.zeros(1 << BITS, bool)
    out, upto = [], np.zeros(len(block) + 1, np.int64)
    for k, (a, b, f, g) in enumerate(zip(words.offset[:-1].tolist(), (words.offset[1:] - 1).tolist(), words.first[:-1].tolist(), words.first[1:].tolist())):
        seen[three[a : max(a, b - 2)]] = True
        seen[one[f:g]] = True
        if g > f:
            seen[two[f : g - 1]] = True
        got = np.flatnonzero(seen)
        seen[got] = False
        out.append(got)
        upto[k + 1] = upto[k] + len(got)
    return np.concatenate(out), upto


def log_count_ratios(counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """From counts of each n-gram in rows of label 0 and 1, and the numbers of rows; smoothing is shared out by class, so an n-gram never seen has ratio 0."""
    share = 2 * SMOOTH * rows / max(rows.sum(), 1)
    rate = (counts + share[:, None]) / np.maximum(rows, 1)[:, None]
    return np.log(np.maximum(rate[1], 1e-12) / np.maximum(rate[0], 1e-12))


def fit_hinge(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, cost: np.ndarray, passes: int = PASSES) -> np.ndarray:
    """Weights of a linear hinge-loss model by dual coordinate descent; rows are (indices, values)."""
    w, alpha = np.zeros(size), np.zeros(len(x))
    square = np.array([v @ v for _, v in x])
    rng = np.random.default_rng(1)
    for _ in range(passes):
        for i in rng.permutation(len(x)).tolist():
            if square[i] > 0:
                k, v = x[i]
                gradient = y[i] * (w[k] @ v) - 1
                new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
                if new != alpha[i]:
                    w[k] += (new - alpha[i]) * y[i] * v
                    alpha[i] = new
    return w


def fit_curve(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve, by Newton's method with smoothed targets."""
    n1, n0 = label.sum(), (1 - label).sum()
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * margin + b)))
        g = np.array([((p - target) * margin).sum(), (p - target).sum()])
        q = p * (1 - p)
        h = np.array([[(q * margin * margin).sum(), (q * margin).sum()], [(q * margin).sum(), q.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(max(a, 1e-6)), float(b)


@dataclass
class Model:
    """Ratios, their products with the weights, the intercept, and the curve."""

    ratio: np.ndarray
    product: np.ndarray
    bias: float
    slope: float
    offset: float

    def margins(self, block: list[bytes]) -> np.ndarray:
        index, upto = features(block)
        sums = np.concatenate(([0.0], np.cumsum(self.product[index])))
        squares = np.concatenate(([0.0], np.cumsum(self.ratio[index] ** 2)))
        length = np.sqrt(np.maximum(np.diff(squares[upto]), 1e-12))
        return np.diff(sums[upto]) / length + self.bias

    def scores(self, block: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.margins(block) + self.offset)))


def fit_model(sample: list[tuple[np.ndarray, int]], ratio: np.ndarray) -> Model:
    """Half of each class fits the curve for the margins of a model fitted on the other half; the model itself uses all."""
    y = np.array([2 * label - 1 for _, label in sample], float)
    size = len(ratio)
    x = []
    for index, _ in sample:
        v = ratio[index]
        v = v / np.sqrt(max((v * v).sum(), 1e-12))
        x.append((np.append(index, size), np.append(v, 1.0)))
    weight = np.full(len(y), COST)
    half = np.arange(len(y)) % 2 == 0
    first = [k for k in np.flatnonzero(half)]
    part = fit_hinge([x[k] for k in first], y[first], size + 1, weight[first])
    rest = np.flatnonzero(~half)
    margin = np.array([part[x[k][0]] @ x[k][1] for k in rest])
    slope, offset = fit_curve(margin, (y[rest] > 0).astype(float))
    w = fit_hinge(x, y, size + 1, weight)
    return Model(ratio, w[:-1] * ratio, float(w[-1]), slope, offset)


def neutral() -> Model:
    """Scores everything 0.5."""
    zero = np.zeros(1 << BITS, np.float32)
    return Model(zero, zero, 0.0, 1.0, 0.0)


def _gather(fraction: float):
    """Counts by range of n-grams, label and partition (key), numbers of rows (range -2), and the n-grams of sampled rows (range -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
        kinds = {"range": pa.int32(), "label": pa.int32(), "key": pa.int64(), "payload": pa.binary()}

        def batch_of(r: list, label: list, key: list, payload: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((r, label, key, payload), kinds.values())], names=list(kinds))

        for batch in batches:
            doc, label = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("label").to_numpy(zero_copy_only=False)
            at = 0
            for block in blocks(t.encode() for t in batch.column("text").to_pylist()):
                index, upto = features(block)
                many = np.diff(upto)
                some = label[at : at + len(block)]
                for k in (0, 1):
                    counts[k] += np.bincount(index[np.repeat(some == k, many)], minlength=1 << BITS)
                    rows[k] += (some == k).sum()
                key = mix(doc[at : at + len(block)].astype(np.int64).view(U64) + U64(1)) >> U64(1)
                take = np.flatnonzero(key < U64(min(int(fraction * 2**63), 2**63)))
                if len(take):
                    yield batch_of([-1] * len(take), some[take].tolist(), key[take].astype(np.int64).tolist(), [index[upto[k] : upto[k + 1]].astype(np.int32).tobytes() for k in take])
                at += len(block)
        yield batch_of([-2, -2], [0, 1], rows.tolist(), [b"", b""])
        for r in range((1 << BITS) // _RANGE):
            part = counts[:, r * _RANGE : (r + 1) * _RANGE]
            here = TaskContext.get().partitionId()
            yield batch_of([r, r], [0, 1], [here, here], [part[0].tobytes(), part[1].tobytes()])

    return run


def _sum_counts(table: pa.Table) -> pa.Table:
    whole = np.zeros(_RANGE, np.int64)
    for chunk in table.column("payload").chunks:
        for x in chunk:
            whole += np.frombuffer(x.as_py(), np.int64)
    return pa.table({c: table.column(c).slice(0, 1) for c in ("range", "label", "key")} | {"payload": pa.array([whole.tobytes()], pa.binary())})


def _summed(counts: DataFrame, parts: int) -> DataFrame:
    """Counts of all ``parts`` partitions together; no task sums more than FAN_IN of them at once."""
    kind = "range int, label int, key long, payload binary"
    while parts > 1:
        counts = counts.withColumn("key", F.floor(F.col("key") / FAN_IN)).groupBy("range", "label", "key").applyInArrow(_sum_counts, kind)
        parts = -(-parts // FAN_IN)
    return counts


def fit(docs: DataFrame, labels: DataFrame, train: Column, label: str = "quality") -> Model:
    """A model from the rows of ``docs`` that ``train`` admits and ``labels`` marks; only their texts are inputs."""
    spark = docs.sparkSession
    small_batches(spark)
    marks = labels.filter(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    marks = materialize(marks, "labels")
    known = marks.count()
    rows = join_even(documents(docs.filter(train)), marks, ["doc_id"])
    found = materialize(rows.select("doc_id", "text", "label").mapInArrow(_gather(1.25 * SAMPLE / max(known, 1)), "range int, label int, key long, payload binary"), "counts")
    n = {r["label"]: r["n"] for r in found.filter("range = -2").groupBy("label").agg(F.sum("key").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return neutral()
    summed = _summed(found.filter("range >= 0"), 1 + found.filter("range >= 0").agg(F.max("key")).first()[0])
    counts = np.zeros((2, 1 << BITS), np.int64)
    for r in summed.collect():  # a fixed number of rows, two for each range of n-grams
        counts[r["label"], r["range"] * _RANGE : (r["range"] + 1) * _RANGE] = np.frombuffer(r["payload"], np.int64)
    ratio = log_count_ratios(counts, np.array([n[0], n[1]])).astype(np.float32)

    def train_one(table: pa.Table) -> pa.Table:
        data = sorted(zip(table.column("key").to_pylist(), table.column("label").to_pylist(), table.column("payload").to_pylist()))
        model = fit_model([(np.frombuffer(p, np.int32), y) for _, y, p in data], ratio.astype(np.float64))
        return pa.table({"product": pa.array([model.product.astype(np.float32).tobytes()], pa.binary()), "numbers": pa.array([[model.bias, model.slope, model.offset]], pa.list_(pa.float64()))})

    sample = found.filter("range = -1").orderBy("key", "label").limit(SAMPLE).withColumn("one", F.lit(1))
    got = sample.groupBy("one").applyInArrow(train_one, "product binary, numbers array<double>").first()
    return Model(ratio, np.frombuffer(got["product"], np.float32), *got["numbers"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs``: doc_id and score, higher where label 1 is likelier."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for block in blocks(t.encode() for t in batch.column("text").to_pylist()):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(block)), pa.array(model.scores(block).astype(np.float64))], names=["doc_id", "score"])
                at += len(block)

    return documents(docs).mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of ``docs``, with all columns, that score ``least`` or more."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_row").field("text").to_pylist()
            good = [model.scores(block) >= least for block in blocks((t or "").encode() for t in texts)]
            if good:
                yield batch.filter(pa.array(np.concatenate(good)))

    rows = packed(docs)  # a column of any name goes through Arrow as a field
    return rows.mapInArrow(run, rows.schema).select("_row.*")
