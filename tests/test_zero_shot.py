"""Nearest prompts by products of matrices: the rows of a plain ranking, for odd vectors and many blocks too."""

import numpy as np
import pytest

from earshot.operators import embed
from earshot.plans import queries


def plain(clips, prompts, top):
    """Ranks by cosine, then by id; pairs without a cosine come last."""
    usable = lambda v: v is not None and None not in v and bool(np.isfinite(v).all())
    norm = lambda v: max(np.sqrt(np.dot(v, v)), 1e-12)
    out = []
    for i, x in clips:
        pairs = []
        for p, y in prompts:
            both = usable(x) and usable(y) and len(x) == len(y)
            pairs.append((not both, -round(float(np.dot(x, y)) / (norm(x) * norm(y)), 9) if both else 0.0, p))
        out += [(i, k + 1, p, None if none else -s) for k, (none, s, p) in enumerate(sorted(pairs)[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [16_384, 7])
def test_ranks_of_odd_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(embed, "PROMPTS", block)
    rng = np.random.default_rng(3)
    some = [rng.integers(-2, 3, 4).astype(float).tolist() for _ in range(30)]
    odd = [None, [1.0, None, 0.0, 1.0], [float("nan")] * 4, [float("inf"), 0.0, 0.0, 0.0], [0.0] * 4, [1.0, 2.0]]
    clips = list(enumerate([*some, *some[:5], *odd]))
    for prompts in (list(enumerate([*odd, *some[:9], *some[:9], *some[:9], *some[:9]])), list(enumerate(odd))):  # copies of a prompt tie
        frames = [spark.createDataFrame(rows, f"{name} long, embedding array<float>").repartition(3) for rows, name in ((clips, "vec_id"), (prompts, "prompt_id"))]
        made = embed.zero_shot(*frames, 3).collect()
        got = sorted([(r["vec_id"], r["rank"], r["prompt_id"], None if r["similarity"] is None else round(r["similarity"], 9)) for r in made], key=str)
        assert got == plain(clips, prompts, 3)


def test_parts_of_cosines(monkeypatch):
    rng = np.random.default_rng(4)
    x, y = rng.standard_normal((50, 6)), rng.standard_normal((20, 6))
    whole = embed.nearest(x, y, 3)
    monkeypatch.setattr(embed, "CELLS", 64)
    assert all(np.array_equal(a, b) for a, b in zip(whole, embed.nearest(x, y, 3))) and len(whole[0]) == 150


def test_vectors_are_multiplied_as_matrices(spark, sf_dir):
    plan = queries.queries()["zero_shot_topk"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "zip_with" not in plan
