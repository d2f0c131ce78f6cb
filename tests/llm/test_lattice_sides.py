"""Lattice cells find close pairs whatever the number of dimensions."""

import numpy as np
import pytest

from earshot.llm import lattice


@pytest.mark.parametrize("dim", [8, 16, 32, 64, 128])
def test_pairs_at_the_threshold_meet(dim):
    rng = np.random.default_rng(dim)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x = unit(rng.standard_normal((3000, dim)))
    y = rng.standard_normal((3000, dim))
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * unit(y - (x * y).sum(axis=1, keepdims=True) * x)
    (own_x, more_x), (own_y, more_y) = lattice.cells(x), lattice.cells(y)
    met = (own_x == own_y) | (more_x == own_y[:, :, None]).any(axis=2) | (more_y == own_x[:, :, None]).any(axis=2)
    assert met.any(axis=1).mean() > 0.999
    other = np.roll(own_y, 1, axis=0)
    assert ((own_x == other) | (more_x == other[:, :, None]).any(axis=2)).any(axis=1).mean() < 0.02
