"""Near-duplicate embeddings with planted copies against brute force, in crowded cells too."""

import numpy as np
import pytest

from earshot.llm import lattice

DIM = 64


def planted(seed=7):
    """Vectors of which some are pairs near the threshold, some families, some equal."""
    rng = np.random.default_rng(seed)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)

    def near(x, low, high):
        y = rng.standard_normal(x.shape)
        y = unit(y - (x * y).sum(axis=1, keepdims=True) * x)
        c = rng.uniform(low, high, (len(x), 1))
        return c * x + np.sqrt(1 - c * c) * y

    base = unit(rng.standard_normal((1500, DIM)))
    pairs = near(base[:1000], 0.95, 0.97)
    tight = near(np.repeat(base[:1], 400, axis=0), 0.985, 0.999)
    loose = near(np.repeat(base[1:2], 300, axis=0), 0.95, 0.99)
    x = np.concatenate((base, pairs, tight, loose, base[:40], base[:40] * 3)).astype(np.float32)
    return x[rng.permutation(len(x))]


def brute(x):
    x = x.astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = x @ x.T
    np.fill_diagonal(c, 0)
    return c


@pytest.mark.parametrize("crowd,block", [(32, 2048), (3, 50)])
def test_links_of_planted_copies(spark, monkeypatch, crowd, block):
    monkeypatch.setattr(lattice, "CROWD", crowd)
    monkeypatch.setattr(lattice, "BLOCK", block)
    x = planted()
    c = brute(x)
    got = {r["vec_id"]: r for r in lattice.linked(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()}
    n = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (n <= (c >= 0.95 - 1e-9).sum(axis=1)).all()
    sure = (c >= 0.95 + 1e-9).sum(axis=1)
    assert n.sum() >= 0.999 * sure.sum() and (n == sure).mean() > 0.99
    if (n == sure).all():  # then components are those of the whole graph
        label = np.arange(len(x))
        while True:
            low = np.minimum(label, np.where(c >= 0.95, label[None, :], len(x)).min(axis=1))
            if (low == label).all():
                break
            label = low
        assert [got[i]["component_id"] for i in range(len(x))] == label.tolist()


def test_rows_grow_with_the_members_of_a_crowd(spark):
    """What a family of near copies leaves behind is a row for each member and cell, never one for each pair."""
    rng = np.random.default_rng(1)
    base = rng.standard_normal(DIM)
    made = []
    for size in (300, 600):
        x = base + 0.03 * rng.standard_normal((size, DIM))
        nodes = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)], "node long, copies long, vector array<double>")
        few, many = lattice.meetings(nodes)
        lists = many.groupBy("node").agg({"bucket": "collect_list"}).toDF("node", "near")
        full = nodes.join(lists, "node", "left").withColumn("inside", lists["near"])
        made.append((lattice.candidates(few).count(), lattice.crowded(many, full).count()))
    (pairs_1, rows_1), (pairs_2, rows_2) = made
    assert rows_2 <= 2.5 * rows_1 + 50 and rows_2 <= 600 * lattice.TABLES * (1 + lattice.PROBES)
    assert pairs_2 <= 2.5 * pairs_1 + 600 * lattice.CROWD


def test_sketches_keep_pairs_at_the_threshold():
    rng = np.random.default_rng(3)
    for dim in (8, 64):
        unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
        x, y = unit(rng.standard_normal((20_000, dim))), rng.standard_normal((20_000, dim))
        y = 0.95 * x + np.sqrt(1 - 0.95**2) * unit(y - (x * y).sum(axis=1, keepdims=True) * x)
        apart = np.unpackbits((lattice.sketches(x) ^ lattice.sketches(y)).view(np.uint8), axis=1).sum(axis=1)
        assert (apart <= lattice.DIFFERENT).mean() > 0.999
