"""Moves over plain lists are those over arrays."""

import numpy as np
import pytest

from motifloom.operators import community as C


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("even", [True, False])
def test_sparse_moves_equal_those_over_arrays(monkeypatch, seed, even):
    """Also with equal weights, where gains tie; nodes without edges and loops included."""
    rng = np.random.default_rng(seed)
    n, m = 300, 900
    src, dst = rng.integers(0, n - 5, m), rng.integers(0, n - 5, m)
    src = np.where(rng.random(m) < 0.1, dst, src)
    g = C.Graph(n, src, dst, np.ones(m) if even else rng.random(m))
    sparse = C.leiden(g, seed)
    monkeypatch.setattr(C, "SPARSE", -1)
    assert (C.leiden(g, seed) == sparse).all()


def test_sparse_graphs_make_no_arrays_per_node(monkeypatch):
    g = C.Graph(50, np.arange(50), (np.arange(50) + 1) % 50, np.ones(50))
    calls, unique = [], np.unique
    monkeypatch.setattr(C.np, "unique", lambda *a, **k: (calls.append(1), unique(*a, **k))[1])
    C.leiden(g, 1)
    assert len(calls) < 50
