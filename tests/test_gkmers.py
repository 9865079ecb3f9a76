"""Coarse neighbours write blocks of postings, no sums of pairs."""

import os

import numpy as np

from motifloom.operators import gkmers


def test_common_kmers_leave_no_pairs_on_disk(spark, monkeypatch):
    """1500 ids that share three k-mers: 2.25 million pairs meet, and less than a byte of each is written."""
    size, kept = [], gkmers.kept

    def weighed(df, name):
        out = kept(df, name)
        size.extend(os.path.getsize(f.removeprefix("file://").replace("file:", "")) for f in out.inputFiles())
        return out

    monkeypatch.setattr(gkmers, "kept", weighed)
    ids = spark.range(1500)
    rows = ids.selectExpr("id", "explode(sequence(1L, 3L)) gkmer").selectExpr("id", "gkmer", "1D + (id * gkmer) % 7 value", "0 nth")
    got = gkmers.coarse_knn(rows, rows, ids, 2).where("rank = 1").collect()
    assert len(got) == 1500 and all(abs(r.sim - 1) < 1e-9 for r in got)
    assert size and sum(size) < 1500 * 1500 / 4


def test_who_has_neighbours_looks_at_common_kmers_only(monkeypatch):
    """Pairs without a common k-mer cost nothing once k positive ones are known; the best are those of all pairs."""
    rng = np.random.default_rng(3)
    n, k, names = 600, 3, 400
    sides = []
    for _ in range(2):
        at = np.repeat(np.arange(n), 5)
        sides.append((at, rng.integers(0, names, len(at)), rng.normal(size=len(at))))
    full = np.zeros((2, n, names))
    for side, (at, name, value) in zip(full, sides, strict=True):
        value[at == 7] = 0  # has no neighbour at all
        np.add.at(side, (at, name), value)

    def block(low, high):
        parts = []
        for at, name, value in sides:
            mine = np.flatnonzero((at >= low) & (at < high))
            mine = mine[np.argsort(name[mine], kind="stable")]
            parts.append((at[mine] - low, name[mine], value[mine]))
        return parts

    asking = gkmers._Asking([(np.arange(n), *block(0, n)[0])], k)
    looked, most = [], np.maximum
    monkeypatch.setattr(gkmers.np, "maximum", lambda a, b, *c, **d: (looked.append(np.size(a)), most(a, b, *c, **d))[1])
    for first in range(0, n, 100):
        looked.clear()
        asking.meet(np.arange(first, first + 100), block(first, first + 100))
    assert sum(looked) < 0.1 * n * 100
    sims = np.round(most(full[0] @ full[0].T, full[0] @ full[1].T), 12)
    order = np.lexsort((np.broadcast_to(np.arange(n), sims.shape), -sims), axis=1)[:, :k]
    assert (asking.best.js == order).all()
    assert np.allclose(asking.best.sims, np.take_along_axis(sims, order, axis=1), atol=1e-9)
