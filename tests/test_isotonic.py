"""The ranged isotonic fit against the max-min formula."""

import numpy as np
import pytest

from motifloom.operators import isotonic, signal


def max_min(score, label, weight, increasing):
    """score -> the largest over starts at or below of the smallest over ends at or above of the mean in between."""
    names = np.unique(score)
    names = names if increasing else names[::-1]
    w = np.array([weight[score == v].sum() for v in names])
    t = np.array([(label * weight)[score == v].sum() for v in names])
    sums, sizes = np.r_[0, np.cumsum(t)], np.r_[0, np.cumsum(w)]
    n, out = len(names), {}
    mean = [[(sums[b + 1] - sums[a]) / (sizes[b + 1] - sizes[a]) if b >= a else None for b in range(n)] for a in range(n)]
    worst = [np.minimum.accumulate(np.array(mean[a][a:])[::-1])[::-1] for a in range(n)]  # [a][k - a]: least over b >= k
    for k in range(n):
        fit = max(worst[a][k - a] for a in range(k + 1))
        out[names[k]] = fit
    return out


CASES = {
    "trend": lambda r, n: (np.linspace(0, 3, n) + r.normal(size=n)),
    "flat": lambda r, n: r.normal(size=n),
    "falling": lambda r, n: -np.linspace(0, 3, n) + 0.1 * r.normal(size=n),
    "saw": lambda r, n: np.tile(np.linspace(0, 1, n // 4 + 1), 4)[:n],
    "steps": lambda r, n: np.floor(np.linspace(0, 4, n)) + (r.random(n) < 0.1),
}


@pytest.mark.parametrize("name", sorted(CASES))
@pytest.mark.parametrize("parts", [1, 5])
def test_fit_equals_max_min_formula(spark, name, parts):
    rng = np.random.default_rng(3)
    n = 150
    score, label, weight = np.sort(rng.integers(0, 120, n)).astype(float), CASES[name](rng, n), rng.choice([0.5, 1.0, 3.0], n)
    rows = spark.createDataFrame([tuple(map(float, r)) for r in zip(score, label, weight)] + [(1.0, 5.0, 0.0), (None, 1.0, 1.0), (2.0, None, 1.0)], "score double, label double, weight double")
    for increasing in (True, False):
        got = {r.score: r.fit for r in isotonic.isotonic_fit(rows, increasing=increasing, parts=parts).collect()}
        assert got == pytest.approx(max_min(score, label, weight, increasing))


def test_edges(spark):
    schema = "score double, label double, weight double"
    assert isotonic.isotonic_fit(spark.createDataFrame([], schema)).count() == 0
    assert [tuple(r) for r in isotonic.isotonic_fit(spark.createDataFrame([(2.0, 3.0, 1.0)], schema)).collect()] == [(2.0, 3.0)]


def test_thresholds_at_a_false_discovery_rate(spark):
    rng = np.random.default_rng(1)
    seen, null = np.r_[rng.normal(0, 1, 300), rng.normal(4, 1, 60)].round(2), rng.normal(0, 1, 200).round(2)
    fits = max_min(np.r_[seen, null], np.r_[np.ones(360), np.zeros(200)], np.r_[np.ones(360), np.full(200, 360 / 200)], True)
    p0 = fits[seen.min()]
    share = min(max(-1 / (1 - 1 / max(p0, 1e-7)), 0.95), 1.0)
    precision = {v: 1.0 if v == seen.max() else min(1.0, max(0.0, 1 + share * (1 - 1 / max(fits[v], 1e-7)))) for v in set(seen)}
    frames = [spark.createDataFrame([(float(v),) for v in x], "score double") for x in (seen, null)]
    got = signal.isotonic_precision(*frames, increasing=True)
    assert {r.score: r.precision for r in got.collect()} == pytest.approx(precision)
    assert signal.fdr_threshold(got, 0.2, increasing=True) == min(v for v, p in precision.items() if p >= 0.8)
