"""Queries that SQL cannot express, against plain recomputations over the whole tables."""

import math
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest

from motifloom.plans import carriers, catalogue_patterns


def mode(v, bins=1000):
    lo, hi = v.min(), v.max()
    width = (hi - lo) / bins
    at = int(np.bincount(np.minimum((v - lo) // width, bins - 1).astype(int)).argmax())
    return lo + at * width, lo + (at + 1) * width


def steepest(distances):
    shares = np.arange(1, 20) * 0.05
    q = np.quantile(distances, shares)
    return max(-math.log(1 - p) / d for p, d in zip(shares, q, strict=True) if d > 0)


def max_min(total, weight):
    """The isotonic fit by its formula: over all beginnings the largest of the least means of stretches over the point."""
    sums, sizes = np.concatenate(([0.0], np.cumsum(total))), np.concatenate(([0.0], np.cumsum(weight)))
    fit = np.full(len(total), -np.inf)
    for lo in range(len(total)):
        means = (sums[lo + 1 :] - sums[lo]) / (sizes[lo + 1 :] - sizes[lo])
        fit[lo:] = np.maximum(fit[lo:], np.minimum.accumulate(means[::-1])[::-1])
    return fit


def plain_threshold(observed, null, sign, target):
    """The weakest observed value whose precision is at least 1 - target, by the max-min formula."""
    values = np.unique(np.concatenate((observed, null)) * sign)
    hits = np.zeros(len(values))
    np.add.at(hits, np.searchsorted(values, observed * sign), 1.0)
    weight = hits.copy()
    np.add.at(weight, np.searchsorted(values, null * sign), len(observed) / len(null))
    fit = max_min(hits, weight)[hits > 0]
    p0 = max(fit[0], 1e-7)
    share = min(max(-1 / (1 - 1 / p0), 0.95), 1.0) if p0 < 1 else 0.95
    precision = np.clip(1 + share * (1 - 1 / np.maximum(fit, 1e-7)), 0, 1)
    precision[-1] = 1.0
    return sign * values[hits > 0][precision >= 1 - target - 1e-12][0]


def test_fdr_threshold(spark, sf_dir, duck):
    v = np.array([r[0] for r in duck.sql(f"with {carriers.WINDOWS} select cast(score as double) from win").fetchall()])
    lo, hi = mode(v)
    mu = sum(mode(v[(v > lo) & (v < hi)])) / 2
    above, below = v[v >= mu] - mu, mu - v[v <= mu]
    share, draw = len(above) / (len(above) + len(below)), np.random.RandomState(1234)
    side, u = draw.uniform(size=10_000), draw.uniform(size=10_000)
    null = np.where(side < share, mu - np.log(1 - u) / steepest(above), mu + np.log(1 - u) / steepest(below))
    want = {"positive": plain_threshold(v[v >= 0], null[null >= 0], 1, 0.2), "negative": plain_threshold(v[v < 0], null[null < 0], -1, 0.2)}
    got = {r.side: r.threshold for r in catalogue_patterns.fdr_threshold(spark, sf_dir).collect()}
    assert got == pytest.approx(want)


def correlation(x, y):
    x, y = x - x.mean(), y - y.mean()
    size = math.sqrt((x * x).sum() * (y * y).sum())
    return float((x * y).sum() / size) if size else 0.0


def test_motif_database_match(spark, sf_dir):
    """Every offset and strand of every pair, tails from sums over all outcomes of binned scores, then q-values by rank."""
    motifs = {}
    for r in catalogue_patterns.meme_rows(spark, sf_dir).orderBy("pos").collect():
        motifs.setdefault(str(r.label), []).append([r.a, r.c, r.g, r.t])
    motifs = {k: np.array(x) for k, x in motifs.items()}
    columns = [np.array([float(Decimal(repr(float(v))).quantize(Decimal("0.01"), ROUND_HALF_UP)) for v in c]) for x in motifs.values() for c in x]
    bins = 100
    cell = lambda s: min(max(int((s + 1) / 2 * bins + 1e-9), 0), bins - 1)
    got = {(r.query, r.target): r for r in catalogue_patterns.motif_database_match(spark, sf_dir).collect()}
    assert set(got) == {(q, t) for q in motifs for t in motifs}
    names = sorted(motifs)[:3]  # whole results of three queries
    for q in names:
        query, n, tails = motifs[q], len(motifs[q]), {}
        single = [np.bincount([cell(correlation(row, c)) for c in columns], minlength=bins) / len(columns) for row in query]
        for a in range(n):
            dist = np.ones(1)
            for b in range(a, n):
                longer = np.zeros(len(dist) + bins - 1)
                for k, p in enumerate(single[b]):
                    longer[k : k + len(dist)] += p * dist
                dist = longer
                tails[a, b + 1] = dist
        pvals = {}
        for t, target in motifs.items():
            tried, best = 0, 2.0
            for strand in (target, target[::-1, ::-1]):
                for offset in range(-len(target) + 1, n):
                    a, b = max(0, offset), min(n, offset + len(target))
                    if b - a < 5:
                        continue
                    tried += 1
                    total = sum(correlation(query[i], strand[i - offset]) for i in range(a, b))
                    at = math.floor((total + (b - a)) / 2 * bins + 1e-9)
                    best = min(best, float(tails[a, b][min(max(at, 0), len(tails[a, b]) - 1) :].sum()))
            pvals[t] = 1 - (1 - min(best, 1.0)) ** tried
            assert got[q, t].pval == pytest.approx(pvals[t], rel=1e-5, abs=1e-12)
        ranked, least = sorted(pvals, key=lambda t: (got[q, t].pval, t)), 1.0
        for k in range(len(ranked), 0, -1):
            least = min(least, pvals[ranked[k - 1]] * len(ranked) / k)
            assert got[q, ranked[k - 1]].qval == pytest.approx(least, rel=1e-5, abs=1e-12)
        assert (got[q, q].offset, got[q, q].is_rc) == (0, False)
