"""Nearest rows by blocks against the whole matrix of similarities."""

import numpy as np
import pytest

from motifloom.operators import similarity as S
from motifloom.plans import catalogue_graph


def _plain(ids, x, k):
    sims = np.round(S.jaccard_block(x, x), 12)
    order = np.lexsort((np.broadcast_to(ids, sims.shape), -sims), axis=1)[:, :k]
    return [(int(i), int(j), r, round(float(s), 9)) for i, o, row in zip(ids, order, sims, strict=True) for r, (j, s) in enumerate(zip(ids[o], row[o], strict=True), 1)]


@pytest.mark.parametrize(("block", "k"), [(7, 4), (32_768, 6), (5, 60)])
def test_jaccard_knn_equals_all_pairs(spark, block, k):
    """Copies, zeros, both signs, values far apart, fewer rows than neighbours; ids in no order."""
    rng = np.random.default_rng(2)
    x = np.r_[rng.integers(-3, 4, (30, 5)), rng.integers(-3, 4, (6, 5)).repeat(2, axis=0), np.zeros((3, 5), int), [[10**6, 0, -1, 0, 2]]].astype(float)
    ids = rng.permutation(1000)[: len(x)]
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "id bigint, v array<double>")
    got = sorted((r.i, r.j, r["rank"], round(r.sim, 9)) for r in S.jaccard_knn(rows, k, block=block).collect())
    assert got == sorted(_plain(ids, x, k))


def test_few_pairs_are_compared_exactly(monkeypatch):
    """Bounds leave a small share of the pairs of unlike rows, and lose none of the best."""
    rng = np.random.default_rng(4)
    x, ids = np.round(rng.normal(size=(3000, 64)) * 1e5), np.arange(3000)
    first, second = (S._Block(ids[a:b], x[a:b], 6) for a, b in ((0, 1500), (1500, 3000)))
    for side in (first, second):
        S._meet(side, side)
        side.floors = side.best.sims[:, -1].copy()
        assert (side.best.js == np.array([r[1] for r in _plain(side.ids, side.x, 6)]).reshape(-1, 6)).all()
    pairs, exact = [], S._exact
    monkeypatch.setattr(S, "_exact", lambda a, b, i, j: (pairs.append(len(i)), exact(a, b, i, j))[1])
    S._meet(first, second)
    assert sum(pairs) < 0.15 * 1500 * 1500
    want = np.array([r[1] for r in _plain(ids, x, 6)]).reshape(-1, 6)
    assert (np.r_[first.best.js, second.best.js] == want).all()


def test_all_rows_alike(spark):
    rows = spark.range(600).selectExpr("id", "array(1D, -2D, 0D) v")
    got = S.jaccard_knn(rows, 3, block=200).groupBy("j").count().collect()
    assert {(r.j, r["count"]) for r in got} == {(0, 600), (1, 600), (2, 600)}


def test_neighbours_are_found_once(spark, sf_dir):
    """What reads the neighbours several times reads a written table."""
    plan = catalogue_graph.density_weights(spark, sf_dir)._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "MapInPandas" not in plan


def test_fine_similarity_sends_blocks(spark):
    """Pairs asked for, also twice and of unknown ids, against the plain comparison; no join that sends features by pair."""
    rng = np.random.default_rng(6)
    n, positions, width = 40, 9, 2
    fwd, rev = rng.normal(size=(2, n, positions * width))
    features = spark.createDataFrame([(i + 7, fwd[i].tolist(), rev[i].tolist()) for i in range(n)], "id bigint, fwd array<double>, rev array<double>")
    i, j = rng.integers(0, n, (2, 300))
    edges = spark.createDataFrame([(int(a) + 7, int(b) + 7) for a, b in zip(i, j, strict=True)] + [(7, 5000), (5000, 7)], "i bigint, j bigint")
    found = S.fine_similarity(edges, features, positions=positions, width=width)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.i, r.j, round(r.sim, 9)) for r in found.collect())
    best = np.maximum(*(S.jaccard_pairs(x[j], fwd[i], 2, width)[0] for x in (fwd, rev)))
    assert got == sorted((int(a) + 7, int(b) + 7, round(float(s), 9)) for a, b, s in zip(i, j, best, strict=True))


def test_blocks_compare_few_pairs_at_home(monkeypatch):
    """Rows of one block meet once, from floors known beforehand: few pairs are compared in double precision, none is lost."""
    rng = np.random.default_rng(8)
    x, ids = np.round(rng.normal(size=(1200, 64)) * 1e5), rng.permutation(5000)[:1200]
    pairs, exact = [], S._exact
    monkeypatch.setattr(S, "_exact", lambda a, b, i, j: (pairs.append(len(i)), exact(a, b, i, j))[1])
    block = S._Block(ids, x, 6)
    S._meet(block, block)
    assert sum(pairs) < 0.1 * 1200 * 1200 / 2
    assert (block.best.js == np.array([r[1] for r in _plain(ids, x, 6)]).reshape(-1, 6)).all()


@pytest.mark.parametrize("scale", [1e-12, 1.0, 1e9])
def test_bounds_lose_no_neighbour(scale):
    """Values of any scale, sparse rows, copies, opposite rows and rows of zeros, in two blocks."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 7)) * (rng.random((400, 7)) < 0.6) * np.exp(rng.normal(size=(400, 1)) * 3)
    x = np.r_[x, x[:50], -x[:50], np.zeros((3, 7))] * scale
    ids = rng.permutation(9000)[: len(x)]
    first, second = (S._Block(ids[p::2], x[p::2], 5) for p in (0, 1))
    for side in (first, second):
        S._meet(side, side)
    S._meet(first, second)
    got = {(int(i), int(j)): round(float(s), 9) for side in (first, second) for i, js, sims in zip(side.ids, side.best.js, side.best.sims, strict=True) for j, s in zip(js, sims, strict=True)}
    assert got == {(r[0], r[1]): r[3] for r in _plain(ids, x, 5)}
