"""Every query against its SQL twin; queries without one must run and give rows."""

import math

import pytest

from motifloom.plans import catalogue_graph, catalogue_patterns, catalogue_tracks

MODULES = (catalogue_tracks, catalogue_graph, catalogue_patterns)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(name, same):
    same(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, sf_dir):
    assert len(QUERIES[name](spark, sf_dir).schema) > 0
    if name != "pattern_discovery":
        assert not QUERIES[name](spark, sf_dir).isEmpty()


def test_entry(spark):
    import __spark_entry__ as e

    assert not e.entry(spark).isEmpty()
    assert set(e.oracle_sql()) <= set(e.queries())


def test_null_sample_of_long_tracks(spark, sf_dir, monkeypatch):
    """Positions above a million do not run into the next example; nulls come last."""
    rows = [(e, p) for e in (1, 2, 70_000, None) for p in (0, 1, 16_384, 999_999, 1_000_000, 1_000_001, 2_500_000)]
    frame = spark.createDataFrame(rows[::-1], "example bigint, pos int").selectExpr("*", "0.0 score")
    monkeypatch.setattr(catalogue_tracks.G, "window_sums", lambda *_: frame)
    got = {(r.example, r.pos): r.score for r in catalogue_tracks.null_sample(spark, sf_dir).collect()}
    want = {}
    for at, key in enumerate(rows, 1):
        side, u = (at * 6185 % 10007 + 0.5) / 10007, (at * 7919 % 10009 + 0.5) / 10009
        want[key] = 200 - math.log(1 - u) / 0.01 if side < 0.6 else 200 + math.log(1 - u) / 0.02
    assert got == pytest.approx(want, abs=1e-5)
