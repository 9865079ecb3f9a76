"""Graphs reach the tasks that run the seeds, and labels the result, past the driver."""

import numpy as np
import pytest
from pyspark import SparkContext

from motifloom.operators import community as C


def _edges(spark, seed):
    """Parallel edges, one-way edges, loops, nodes with a loop only; ids far apart and negative."""
    rng = np.random.default_rng(seed)
    names = np.sort(rng.choice(10**12, 60, replace=False)) - 10**9
    src, dst = rng.integers(0, 55, (2, 400))
    src, dst = np.r_[src, [57, 58]], np.r_[dst, [57, 58]]
    weight = rng.integers(1, 9, len(src)) / 8  # sums are exact
    return spark.createDataFrame([(int(names[a]), int(names[b]), float(w)) for a, b, w in zip(src, dst, weight, strict=True)], "src bigint, dst bigint, weight double"), names, src, dst, weight


@pytest.mark.parametrize("seed", [1, 2])
def test_labels_are_those_of_the_best_seed(spark, seed, monkeypatch):
    monkeypatch.setattr(C, "PIECE", 50)
    edges, names, src, dst, weight = _edges(spark, seed)
    used = np.unique(np.r_[src, dst])
    g = C.Graph(len(used), np.searchsorted(used, src), np.searchsorted(used, dst), weight)
    best = max((C.leiden(g, s * 100) for s in range(11)), key=lambda label: round(g.quality(label), 12))
    got = {r.node: r.community for r in C.communities(edges, 11).collect()}
    assert got == {int(names[u]): int(c) for u, c in zip(used, best, strict=True)}


def test_neither_graph_nor_labels_pass_the_driver(spark, monkeypatch):
    edges, names, *_ = _edges(spark, 3)

    def never(*_, **__):
        raise AssertionError("rows in the driver")

    for of, name in ((type(edges), "toPandas"), (type(spark), "createDataFrame"), (SparkContext, "broadcast")):
        monkeypatch.setattr(of, name, never)
    assert C.communities(edges, 3).count() == len(names) - 3


def test_pieces_change_no_sums(monkeypatch):
    """Merging and quality over a few nodes at a time are those over all."""
    rng = np.random.default_rng(5)
    g = C.Graph(200, *rng.integers(0, 200, (2, 3000)), rng.random(3000))
    label = rng.integers(0, 20, 200)
    whole = g.merged(label, 20)
    monkeypatch.setattr(C, "PIECE", 40)
    parts = g.merged(label, 20)
    for name in ("to", "weight", "start", "loops", "degree"):
        assert (getattr(whole, name) == getattr(parts, name)).all()
    assert sum(1 for _ in g.pieces()) > 20 and g.quality(label) == pytest.approx(whole.quality(np.arange(20)), abs=1e-12)


def test_dense_graphs_as_of_a_discovery_pass_by_the_driver(spark, monkeypatch):
    """Every node a neighbour of all others, stored both ways with a loop each, over the bound of sparse moves."""
    rng = np.random.default_rng(4)
    n = 90
    weight = np.triu(rng.integers(1, 4, (n, n)) / 8 + np.kron(np.eye(3), np.ones((30, 30))))
    weight = np.maximum(weight, weight.T)
    src, dst = np.indices((n, n)).reshape(2, -1)
    edges = spark.createDataFrame([(int(a), int(b), float(weight[a, b])) for a, b in zip(src, dst, strict=True)], "src bigint, dst bigint, weight double")

    def never(*_, **__):
        raise AssertionError("rows in the driver")

    for of, name in ((type(edges), "toPandas"), (type(spark), "createDataFrame"), (SparkContext, "broadcast")):
        monkeypatch.setattr(of, name, never)
    got = {r.node: r.community for r in C.communities(edges, 4).collect()}
    assert [len({got[k] for k in range(first, first + 30)}) for first in (0, 30, 60)] == [1, 1, 1] and len(set(got.values())) == 3
