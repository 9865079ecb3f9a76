"""Non-SQL operators against slow models and planted structure."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest

from motifloom.operators import building as B
from motifloom.operators import community, gkmers, matching, similarity


def slow_gkmers(letters, importance, topn, min_k, max_k, max_len, max_gap):
    keep = sorted(sorted(range(len(letters)), key=lambda p: (-importance[p], p))[:topn])
    found = {}
    for k in range(min_k, max_k + 1):
        for c in itertools.combinations(keep, k):
            if c[-1] - c[0] < max_len and all(b - a <= max_gap for a, b in zip(c, c[1:])):
                h = sum((letters[p] + 1) * 5 ** (p - c[0]) for p in c)
                found[h] = found.get(h, 0) + sum(importance[p] for p in c) / k
    return {h: v for h, v in found.items() if v}


@pytest.mark.parametrize("seed", range(4))
def test_gapped_kmers(seed):
    rng = np.random.default_rng(seed)
    letters, imp = rng.integers(0, 4, 20), rng.integers(-5, 6, 20).astype(float)
    names, values = gkmers.gapped_kmers(letters, imp, topn=9, min_k=3, max_k=5, max_len=8, max_gap=4, max_entries=10**6)
    want = slow_gkmers(letters.tolist(), imp.tolist(), 9, 3, 5, 8, 4)
    assert dict(zip(names.tolist(), values.round(9).tolist())) == {h: round(v, 9) for h, v in want.items() if round(v, 12)}


def test_jaccard_block():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(5, 12)), rng.normal(size=(7, 12))
    want = [[sum(math.copysign(1, x) * math.copysign(1, y) * min(abs(x), abs(y)) for x, y in zip(r, s)) / sum(max(abs(x), abs(y)) for x, y in zip(r, s)) for s in b] for r in a]
    assert np.allclose(similarity.jaccard_block(a, b), want)
    assert (similarity.jaccard_block(np.zeros((1, 4)), np.zeros((1, 4))) == 0).all()


def best_modularity(g):
    def partitions(n):
        if n == 0:
            yield []
            return
        for p in partitions(n - 1):
            for k in range(max(p, default=-1) + 2):
                yield [*p, k]

    return max(g.quality(np.array(p)) for p in partitions(g.n))


@pytest.mark.parametrize("seed", range(5))
def test_leiden_on_small_graphs(seed):
    rng = np.random.default_rng(seed)
    pairs = [(i, j) for i in range(7) for j in range(i + 1, 7) if rng.random() < 0.45]
    src, dst = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    g = community.Graph(7, src, dst, rng.random(len(pairs)) + 0.1)
    best = max(g.quality(community.leiden(g, s)) for s in range(10))
    assert best == pytest.approx(best_modularity(g), abs=1e-9)


def test_leiden_planted_blocks():
    rng = np.random.default_rng(1)
    truth = np.repeat([0, 1, 2], 30)
    i, j = np.triu_indices(90, 1)
    keep = rng.random(len(i)) < np.where(truth[i] == truth[j], 0.5, 0.03)
    g = community.Graph(90, i[keep], j[keep], np.ones(keep.sum()))
    label = community.leiden(g, 0)
    assert len(set(zip(label.tolist(), truth.tolist()))) == 3


@pytest.mark.parametrize("most_edges", [1_000_000, 900, 0])
def test_communities_within_and_beyond_the_bound(spark, most_edges):
    rng = np.random.default_rng(2)
    truth = np.repeat(np.arange(6), 20)
    i, j = np.triu_indices(120, 1)
    keep = rng.random(len(i)) < np.where(truth[i] == truth[j], 0.6, 0.02)
    edges = spark.createDataFrame(pd.DataFrame({"src": i[keep] + 1000, "dst": j[keep] + 1000, "weight": np.ones(keep.sum())}))
    assert edges.count() > 900 // 2
    found = community.communities(edges, 4, most_edges).toPandas()
    assert sorted(found["node"]) == list(range(1000, 1120))
    label = found.sort_values("node")["community"].to_numpy()
    g = community.Graph(120, i[keep], j[keep], np.ones(keep.sum()))
    assert g.quality(label) >= 0.95 * g.quality(truth)
    assert sorted(set(label)) == list(range(len(set(label))))
    assert (np.diff(np.bincount(label)) <= 0).all()


def test_communities_of_nothing_loops_and_nulls(spark):
    schema = "src long, dst long, weight double"
    assert community.communities(spark.createDataFrame([], schema), 2).count() == 0
    rows = spark.createDataFrame([(1, 1, 1.0), (2, 3, 1.0), (3, 2, 1.0), (None, 2, 1.0), (2, 5, None)], schema)
    for bound in (100, 1):
        found = {r.node: r.community for r in community.communities(rows, 2, bound).collect()}
        assert found == {2: 0, 3: 0, 1: 1}


def small_tracks(n=12, length=60, word=(2, 0, 3, 3, 0, 1, 0, 2), seed=0):
    rng = np.random.default_rng(seed)
    tracks, seqlets = B.Tracks(), []
    for e in range(n):
        letters = rng.integers(0, 4, length)
        w, at, rc = np.array(word), int(rng.integers(20, 30)), bool(e % 2)
        letters[at : at + 8] = 3 - w[::-1] if rc else w
        hyp = rng.normal(0, 0.01, (length, 4))
        hyp[np.arange(at, at + 8), letters[at : at + 8]] = 1
        tracks[e] = (np.eye(4)[letters], hyp)
        shift = int(rng.integers(-2, 3))
        seqlets.append(B.Seqlet(e, at - 3 + shift, at + 11 + shift, False))
    return tracks, seqlets


def test_merge_aligns_strands_and_offsets():
    tracks, seqlets = small_tracks()
    p = B.merge(B.Pattern(tracks, seqlets[:1]), seqlets[1:], min_overlap=0.5)
    assert len(p.seqlets) == 12
    polished = B.polish(p, min_share=0.2, min_n=3, flank=2, window=8, background=np.full(4, 0.25))
    top = polished.means[0].max(axis=1)
    assert (np.sort(top)[-8:] > 0.99).all() and len(polished) == 12


def test_merge_plan_rules():
    sim = np.array([[1, 0.95, 0.1], [0.95, 1, 0.1], [0.1, 0.1, 1]])
    mixed = np.array([[0.5, 0.55, 1], [0.55, 0.5, 1], [1, 1, 0.5]])
    assert B.merge_plan(sim, mixed) == [(0, 1)]
    assert B.merge_plan(sim, np.where(np.eye(3) > 0, 0.5, 1.0)) == []


def test_rank_auroc():
    assert B.rank_auroc(np.array([2.0, 3.0]), np.array([0.0, 1.0])) == 1.0
    assert B.rank_auroc(np.array([1.0, 1.0]), np.array([1.0])) == 0.5
    assert B.rank_auroc(np.array([]), np.array([1.0])) == 0.5


def test_match_finds_reversed_motif(spark):
    rng = np.random.default_rng(3)
    pwms = {f"m{k}": rng.dirichlet(np.full(4, 0.3), 9) for k in range(12)}
    motifs = spark.createDataFrame([(k, v.tolist()) for k, v in pwms.items()], "name string, pwm array<array<double>>")
    query = {"q": pwms["m4"][::-1, ::-1][1:8]}
    best = matching.match_motifs(query, motifs).orderBy("pval").first()
    assert best.target == "m4" and best.is_rc and best.pval < 0.01

@pytest.mark.parametrize("chunk", [3, 2048])
def test_posting_join_equals_all_pairs(spark, chunk, monkeypatch):
    """Common k-mers in chunks, ids without any k-mer, negative sums and zeros in between."""
    rng = np.random.default_rng(8)
    n, k = 40, 12
    sides = []
    for _ in range(2):
        rows = [(i, g, float(v)) for i in range(n - 3) for g, v in zip(rng.choice(30, 5, replace=False).tolist(), rng.normal(size=5))]
        sides.append({(i, g): v for i, g, v in rows + [(i, 99, 0.5) for i in range(0, n - 3, 2)]})
    frames = [spark.createDataFrame([(i + 100, g, v, 0) for (i, g), v in side.items()], gkmers.GKMERS) for side in sides]
    dense = []
    for side in sides:
        m = np.zeros((n, 100))
        for (i, g), v in side.items():
            m[i, g] = v
        size = np.linalg.norm(m, axis=1, keepdims=True)
        dense.append(np.divide(m, size, out=np.zeros_like(m), where=size > 0))
    sim = np.round(np.maximum(dense[0] @ dense[0].T, dense[0] @ dense[1].T), 9)
    found = gkmers.coarse_knn(*frames, spark.range(100, 100 + n), k, chunk=chunk).collect()
    got = {}
    for r in found:
        got.setdefault(r.i - 100, {})[r["rank"]] = (r.j - 100, r.sim)
    for i in range(n):
        order = sorted(range(n), key=lambda j: (-sim[i, j], j))[:k]
        assert [got[i][r][0] for r in range(1, k + 1)] == order
        assert [got[i][r][1] for r in range(1, k + 1)] == pytest.approx(sim[i, order].tolist(), abs=1e-8)


def test_partial_sums_are_handed_on_in_time(monkeypatch):
    monkeypatch.setattr(gkmers, "HELD", 50)
    monkeypatch.setattr(gkmers, "PRODUCTS", 20)
    rows = pd.DataFrame([(g, 0, 0, side, i, 1.0) for g in range(6) for side in (0, 1) for i in range(7)], columns=["gkmer", "a", "b", "side", "id", "value"])
    frames = [rows.iloc[k : k + 9] for k in range(0, len(rows), 9)]
    out = list(gkmers._partial_sums(iter(frames)))
    total = np.zeros((7, 7))
    for frame in out:
        for r in frame.itertuples():
            np.add.at(total[r.i], np.asarray(r.js), np.asarray(r.sums))
    assert (total == 6).all() and len(out) > 1
    assert list(gkmers._partial_sums(iter([]))) == []


@pytest.mark.parametrize("block", [3, 256])
def test_nearest_rows_in_blocks(block):
    x = np.random.default_rng(5).integers(-2, 3, (23, 6)).astype(float)
    sims = similarity.jaccard_block(x, x)
    np.fill_diagonal(sims, -np.inf)
    want = np.argsort(-sims, axis=1, kind="stable")[:, :7]
    places, got = similarity.nearest(x, 7, block)
    assert (places == want).all() and (got == np.take_along_axis(sims, want, axis=1)).all()
