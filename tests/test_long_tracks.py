"""Tracks cut into ranges give what whole tracks give, with one track that holds most rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from motifloom.operators import seqlets, signal


def tracks(seed, levels=7):
    rng = np.random.default_rng(seed)
    return {k: rng.integers(-levels, levels, n).astype(float) for k, n in ((1, 700), (2, 3), (3, 60), (None, 40), (4, 1), (5, 0))}


def long_rows(spark, made, schema="example bigint, pos int, attr double"):
    return spark.createDataFrame([(k, p, float(v)) for k, t in made.items() for p, v in enumerate(t)], schema).repartition(5)


@pytest.mark.parametrize("width", [5, 64, 65_536])
def test_window_sums(spark, width):
    made = tracks(1)
    got = {(r.example, r.pos): r.score for r in signal.window_sums(long_rows(spark, made), 5, width=width).collect()}
    assert got == {(k, p): t[p : p + 5].sum() for k, t in made.items() for p in range(len(t) - 4)}


def blanked(scores, flank, suppress):
    """(pos, score) of picking the best and blanking all around it."""
    left, found = dict(scores), []
    while left:
        at = min(left, key=lambda p: (-left[p], p))
        found.append((at, left[at]))
        left = {p: v for p, v in left.items() if abs(p - at) > suppress}
    return found


@pytest.mark.parametrize("width", [1, 16, 65_536])
@pytest.mark.parametrize("suppress", [0, 4, 9])
def test_greedy_picks(spark, width, suppress):
    made = tracks(2)
    made[6] = np.arange(200.0)  # every pick hangs on the next one
    frame = long_rows(spark, made).select("example", "pos", F.col("attr").alias("score")).where("score > -3 or example = 6")
    got = {}
    for r in seqlets.greedy_picks(frame, suppress, width=width).collect():
        got.setdefault(r.example, set()).add((r.pos, r.score))
    for k, t in made.items():
        want = blanked({p: v for p, v in enumerate(t) if v > -3 or k == 6}, 0, suppress)
        assert got.get(k, set()) == set(want)


def test_pick_long(spark):
    made = tracks(3, levels=50)
    scores = long_rows(spark, made).select("example", "pos", F.col("attr").alias("score"))
    rows = seqlets.pick_long(scores, 5, 2, 4, 10.0, -30.0, width=32).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (str(r.example), r.pick)):
        assert (r.start_pos, r.end_pos) == (r.pos - 2, r.pos + 7)
        got.setdefault(r.example, []).append((r.pos, r.score))
    for k, t in made.items():
        inside = {p: abs(v) for p, v in enumerate(t) if (v >= 10 or v <= -30) and 2 <= p < len(t) - 2}
        assert got.get(k, []) == blanked(inside, 2, 4)
    assert seqlets.pick_long(scores.limit(0), 5, 2, 4, 10.0, -30.0).count() == 0


def test_ordinals_of_a_hot_key(spark):
    rows = [("hot" if p % 3 else f"k{p % 11}", p * 7919 % 1000, p) for p in range(1000)] + [(None, 5, 2000), (None, 4, 2001)]
    frame = spark.createDataFrame(rows, "by string, x int, id int")
    want = {}
    order = {}
    for by, x, key in sorted(rows, key=lambda r: (r[1], r[2])):
        want[key] = order.get(by, 0)
        order[by] = order.get(by, 0) + 1
    for most in (None, 1, 40):
        got = {r.id: r.n for r in seqlets.ranged_ordinals(frame, "by", ("x", "id"), "n", most=most).collect()}
        assert got == {k: v for k, v in want.items() if most is None or v < most}
