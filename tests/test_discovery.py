"""Discovery does the library's whole job: rounds, seeds, and merging until nothing merges."""

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from motifloom.functions import tracks as T
from motifloom.operators import building as B
from motifloom.operators import signal
from motifloom.plans import catalogue_patterns, discovery

FIT = {"window", "flank", "trim", "initial_flank"}  # what short tracks need
SMALL = catalogue_patterns.SMALL


def test_registered_query_cuts_nothing():
    fields = [f for f in dataclasses.fields(SMALL) if f.name not in FIT]
    assert {f.name: getattr(SMALL, f.name) for f in fields} == {f.name: f.default for f in fields}


def _chain(spark, n, start=16):
    """n patterns of one seqlet each; from place 16 far enough from the ends of their tracks to be grown."""
    tracks = discovery.kept(spark.range(n).selectExpr("id example_idx", "flatten(array_repeat(array(0, 1, 2, 3), 10)) letters", "array_repeat(array(1d, 1d, 1d, 1d), 40) hyp"), "tracks")
    return tracks, tracks.selectExpr("cast(example_idx as int) pattern", "-1 subpattern", "0 ord", "example_idx", f"{start} start_pos", f"{start} + 6 end_pos", "false is_revcomp")


def test_collapse_ends_when_the_plan_is_empty(spark, monkeypatch):
    rounds = 4
    tracks, members = _chain(spark, rounds + 1)
    plans = []
    monkeypatch.setattr(discovery.B, "merge_plan", lambda sim, _: plans.append(len(sim)) or ([(0, 1)] if len(sim) > 1 else []))
    got = discovery.collapse(members, tracks, [0.25] * 4, SMALL)
    assert got.select("pattern").distinct().count() == 1 and got.count() == rounds + 1 and plans == [5, 4, 3, 2, 1]


def plain_collapse(sizes, plan, refuses):
    """Plain replay of a plan on lists of members; refuses(a, b) says whether nothing is left of a merge."""
    slots = [list(range(100 * k, 100 * k + n)) for k, n in enumerate(sizes)]
    for i, j in plan:
        a, b = slots[i], slots[j]
        if a is not b and not refuses(a, b):
            new = a + b if len(a) >= len(b) else b + a
            slots = [new if x is a or x is b else x for x in slots]
    return [x for k, x in enumerate(slots) if all(x is not y for y in slots[:k])]


class Bag:
    """Stands for a pattern: a list of members."""

    def __init__(self, seqlets):
        self.seqlets = seqlets


@pytest.mark.parametrize("seed", range(6))
def test_plans_are_carried_out_in_order_and_refusals_lose_nothing(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 6, 7).tolist()
    pairs = [(i, j) for i in range(7) for j in range(i + 1, 7)]
    plan = [pairs[k] for k in rng.choice(len(pairs), 8, replace=False)]
    refuses = lambda a, b: (sum(a) + sum(b)) % 3 == seed % 3

    def join(x, y):
        large, small = (y, x) if len(x.seqlets) < len(y.seqlets) else (x, y)
        return None if refuses(x.seqlets, y.seqlets) else Bag(large.seqlets + small.seqlets)

    parts = {k: Bag(list(range(100 * k, 100 * k + n))) for k, n in enumerate(sizes)}
    slot, found, said = B.replay(parts, [(i, j, 50 + k) for k, (i, j) in enumerate(plan)], join, set())
    assert sorted(p.seqlets for p in found.values()) == sorted(plain_collapse(sizes, plan, refuses))
    assert sorted(m for p in found.values() for m in p.seqlets) == sorted(m for p in parts.values() for m in p.seqlets)
    assert set(slot) == set(parts) and set(slot.values()) == set(found)
    again = B.replay(parts, [(i, j, 80 + k) for k, (i, j) in enumerate(plan)], join, {frozenset(p) for p in said})
    assert sorted(p.seqlets for p in again[1].values()) == sorted(p.seqlets for p in found.values())


def test_collapse_of_a_chain_in_plan_order(spark, monkeypatch):
    """The last pair of the chain comes first, and what it makes meets the first pattern."""
    tracks, members = _chain(spark, 3)
    seen = []
    monkeypatch.setattr(discovery.B, "merge_plan", lambda sim, _: seen.append(len(sim)) or ([(1, 2), (0, 1), (0, 2)] if len(sim) == 3 else []))
    got = discovery.collapse(members, tracks, [0.25] * 4, SMALL)
    assert seen == [3, 1] and [r.example_idx for r in got.orderBy("ord").collect()] == [1, 2, 0]


def test_collapse_refuses_without_loss_and_ends(spark, monkeypatch):
    tracks, members = _chain(spark, 4, start=0)  # flanks leave the track, so polishing leaves nothing
    members = members.withColumn("parent", F.lit(7))
    plans = []
    monkeypatch.setattr(discovery.B, "merge_plan", lambda sim, _: plans.append(len(sim)) or [(a, b) for a in range(len(sim)) for b in range(a + 1, len(sim))])
    got = discovery.collapse(members, tracks, [0.25] * 4, SMALL)
    assert sorted(got.collect()) == sorted(members.select(*got.columns).collect()) and plans == [4, 4]


def test_parents_collapse_apart_in_the_same_rounds(spark, monkeypatch):
    tracks, members = _chain(spark, 7)
    members = members.withColumn("parent", F.expr("case when pattern < 3 then 0 when pattern < 6 then 1 else 2 end"))
    rounds = []
    monkeypatch.setattr(discovery.B, "merge_plan", lambda sim, _: [(0, 1)] if len(sim) > 1 else [])
    scored = discovery._scored
    monkeypatch.setattr(discovery, "_scored", lambda m, t, todo, o: rounds.append(len(todo)) or scored(m, t, todo, o))
    got = discovery.collapse(members, tracks, [0.25] * 4, SMALL)
    by = {tuple(r) for r in got.groupBy("parent").agg(F.countDistinct("pattern"), F.count(F.lit(1))).collect()}
    assert by == {(0, 1, 3), (1, 1, 3), (2, 1, 1)} and rounds == [12, 4]


def test_two_kinds_within_a_pattern_are_merged_within_it(spark, monkeypatch):
    """A pattern that is split in four, two and two alike: alike parts merge inside it, and nothing is lost."""
    tracks, rows = _chain(spark, 80)
    rows = rows.selectExpr("0 pattern", "subpattern", "cast(example_idx as int) ord", "example_idx", "start_pos", "end_pos", "is_revcomp")
    whole = discovery.kept(rows, "rows")
    split = lambda m, t, o, min_size=0: m.withColumn("subpattern", F.expr("cast(example_idx % 4 as int)")) if min_size else m
    calls = []

    def plan(sim, _):
        calls.append(len(sim))
        return [(0, 2), (1, 3)] if len(sim) == 4 else []

    monkeypatch.setattr(discovery, "background_of", lambda *_: [0.25] * 4)
    monkeypatch.setattr(discovery, "_strength", lambda r, _: r.withColumn("strength", F.lit(1.0)))
    monkeypatch.setattr(discovery, "graph_of", lambda r, *_, **__: (r.selectExpr("id node", "0 community"), r.select("id")))
    monkeypatch.setattr(discovery.community, "communities", lambda edges, n: edges)
    monkeypatch.setattr(discovery, "build", lambda *_: whole)
    monkeypatch.setattr(discovery, "subclusters", split)
    monkeypatch.setattr(discovery.B, "merge_plan", plan)
    monkeypatch.setattr(discovery, "filtered", lambda m, *_: m.selectExpr("pattern", "pattern place").distinct())
    given = whole.selectExpr("cast(ord as bigint) id", "example_idx", "start_pos", "end_pos", "is_revcomp")
    got = discovery.patterns_of(given, tracks, 1, dataclasses.replace(SMALL, rounds=1))
    kinds = {(r.pattern, r.example_idx % 2) for r in got.collect()}
    assert calls == [4, 2, 2] and len(kinds) == 2 and {k for _, k in kinds} == {0, 1} and got.count() == 80


def test_rounds_and_seeds(spark, monkeypatch):
    rows = spark.range(6).selectExpr("id", "id example_idx", "0 start_pos", "6 end_pos", "false is_revcomp")
    graphs, seeds = [], []

    def graph_of(rows, tracks, sign, o, filtered):
        graphs.append(filtered)
        return rows.selectExpr("id node", "0 community"), rows.select("id")

    def subclusters(members, tracks, o, min_size=0):
        seeds.append(o.n_seeds)
        return members.withColumn("subpattern", F.lit(0))

    def communities(edges, n_seeds):
        seeds.append(n_seeds)
        return edges

    monkeypatch.setattr(discovery, "background_of", lambda *_: [0.25] * 4)
    monkeypatch.setattr(discovery, "_strength", lambda rows, _: rows.withColumn("strength", F.lit(1.0)))
    monkeypatch.setattr(discovery, "graph_of", graph_of)
    monkeypatch.setattr(discovery.community, "communities", communities)
    monkeypatch.setattr(discovery, "build", lambda c, *_: c.selectExpr("community pattern", "-1 subpattern", "cast(id as int) ord", "example_idx", "start_pos", "end_pos", "is_revcomp"))
    monkeypatch.setattr(discovery, "collapse", lambda members, *_: members)
    monkeypatch.setattr(discovery, "filtered", lambda members, *_: members.selectExpr("pattern", "0 place").distinct())
    monkeypatch.setattr(discovery, "subclusters", subclusters)
    assert discovery.patterns_of(rows, rows, 1, SMALL).count() == 6
    assert graphs == [True, False] and seeds == [50, 50, 50, 50]


def test_percentiles_over_ranges(spark):
    rng = np.random.default_rng(4)
    for values in (rng.normal(size=3001), rng.integers(-3, 4, 2000) / 2, np.array([2.5])):
        rows = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "score double").repartition(7)
        shares = [0.0, 0.05, 0.333, 0.5, 0.95, 1.0]
        got = signal.percentiles(rows, F.col("score"), shares).first()
        assert got.n == len(values) and got.q == pytest.approx(np.percentile(values, [100 * s for s in shares]).tolist())
        table = signal.distribution(rows, F.col("score")).orderBy("v").collect()
        distinct, counts = np.unique(values, return_counts=True)
        assert [r.v for r in table] == distinct.tolist() and [r.n for r in table] == counts.tolist()
        assert [r.before for r in table] == (np.cumsum(counts) - counts).tolist()
        for rank in (0.0, 0.4, 1.0):
            assert signal.ecdf_value(rows, rank) == np.sort(np.abs(values))[min(int(rank * len(values)), len(values) - 1)]
    none = signal.percentiles(rows.limit(0), F.col("score"), [0.5]).first()
    assert none.n == 0 and none.q is None


def test_picks_match_blanking(spark):
    """Picks equal those of taking the best and blanking around it, ties and masks included."""
    rng = np.random.default_rng(5)
    for flank, suppress in ((0, 0), (2, 4), (3, 1)):
        rows = [(k, [None if rng.random() < 0.3 else float(rng.integers(0, 6)) for _ in range(int(rng.integers(0, 40)))]) for k in range(40)]
        got = {r.k: [tuple(p) for p in r.picks] for r in spark.createDataFrame(rows, "k int, s array<double>").select("k", T.pick_peaks(F.col("s"), flank, suppress).alias("picks")).collect()}
        for k, scores in rows:
            left, want = list(scores), []
            while any(x is not None for x in left):
                top = max(x for x in left if x is not None)
                at = left.index(top)
                left = [None if abs(i - at) <= suppress else x for i, x in enumerate(left)]
                want += [(at, top)] if flank <= at < len(left) - flank else []
            assert got[k] == want
