"""Patterns of several runs, merged as one run's are."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import seqlets
from . import discovery

#: Merged patterns are trimmed and grown more narrowly than those of one run.
MERGING = discovery.Options(initial_flank=5, trim=20)


def united(runs: Sequence[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(members, tracks) of all runs under common example numbers and pattern numbers.

    Only tracks with members are taken, numbered by run and example. Patterns are numbered within a metacluster by run
    and by name (so 10 comes before 2), the order that decides between patterns of one size.
    """
    tagged = [(m.withColumn("run", F.lit(k)), t.withColumn("run", F.lit(k))) for k, (m, t) in enumerate(runs)]
    members, tracks = (functools.reduce(DataFrame.unionByName, side) for side in zip(*tagged, strict=True))
    used = members.select("run", "example_idx").distinct()
    numbers = discovery.kept(seqlets.pair_ordinals(used, "run", "example_idx", "joint"), "examples")
    joined = lambda rows: rows.join(numbers, ["run", "example_idx"]).withColumn("example_idx", F.col("joint")).drop("joint")
    order = F.dense_rank().over(Window.partitionBy("metacluster").orderBy("run", F.col("pattern").cast("string"))) - 1
    names = members.select("metacluster", "run", "pattern").distinct().withColumn("place", order.cast("int"))  # a row per pattern
    members = joined(members).join(F.broadcast(names), ["metacluster", "run", "pattern"]).withColumn("pattern", F.col("place"))
    members = members.select("metacluster", "pattern", F.lit(-1).alias("subpattern"), "ord", "example_idx", "start_pos", "end_pos", "is_revcomp")
    return members, joined(tracks).drop("run")


def merge_runs(runs: Sequence[tuple[DataFrame, DataFrame]], o: discovery.Options = MERGING) -> tuple[DataFrame, DataFrame]:
    """(members, tracks) of several runs -> (members of the merged patterns, the tracks they lie on).

    Patterns of one sign meet, whatever their run, until none merges; places in the result are by size.
    """
    if not runs:
        raise ValueError("no runs to merge")
    members, tracks = (discovery.kept(x, "united") for x in united(runs))
    background = discovery.background_over(tracks)
    found = []
    for name in ("pos", "neg"):
        part = members.where(F.col("metacluster") == name).drop("metacluster")
        if part.isEmpty():
            continue
        merged = discovery.collapse(part, tracks, background, o)
        sizes = merged.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
        places = sizes.select("pattern", (F.row_number().over(Window.orderBy(F.desc("n"), "pattern")) - 1).cast("int").alias("place"))  # a row per pattern
        merged = merged.join(F.broadcast(places), "pattern").withColumn("pattern", F.col("place")).drop("place")
        found.append(merged.select(F.lit(name).alias("metacluster"), *[c.split()[0] for c in discovery.MEMBERS.split(", ")]))
    return (functools.reduce(DataFrame.unionByName, found) if found else members), tracks
