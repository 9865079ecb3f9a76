"""Isotonic regression by pool-adjacent-violators over ranges.

The points are ranged by value, and each range pools its own. A pool is final where every range behind it begins, and every
range before it ends, on the right side of its mean: nothing out there can reach it. Only the other pools, those at the
borders of ranges that contradict each other, go on; neighbouring ranges are merged two by two, as a tree, until no pool
is left to be contested. Pools stay tables all the way; a task holds the contested pools of two ranges.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept


def pooled(total: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The pool of each point, numbered from 0, where means of neighbouring pools may not fall."""
    tops: list[list[float]] = []  # total, weight, points
    for t, w in zip(total.tolist(), weight.tolist(), strict=True):
        tops.append([t, w, 1])
        while len(tops) > 1 and tops[-2][0] * tops[-1][1] >= tops[-1][0] * tops[-2][1]:
            t2, w2, n2 = tops.pop()
            tops[-1][0] += t2
            tops[-1][1] += w2
            tops[-1][2] += n2
    return np.repeat(np.arange(len(tops)), [int(p[2]) for p in tops])


def _pools(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The points of one range, in order, with their pool: a number that grows with the value over all ranges."""
    whole = [f for f in frames if len(f)]
    if whole:
        points = pd.concat(whole, ignore_index=True)
        yield points.assign(own=(points["part"].to_numpy() << 40) + pooled(points["total"].to_numpy(), points["weight"].to_numpy()))


def _merged(frame: pd.DataFrame) -> pd.DataFrame:
    """Contested pools of two neighbouring ranges, pooled anew."""
    frame = frame.sort_values("own").reset_index(drop=True)
    groups = frame.drop_duplicates("top")  # pools that are one already stay one
    at = pooled(groups["sum"].to_numpy(), groups["size"].to_numpy())
    firsts = groups["top"].to_numpy()[np.unique(at, return_index=True)[1]]
    total, size = np.bincount(at, groups["sum"]), np.bincount(at, groups["size"])
    now = pd.Series(at, index=groups["top"].to_numpy()).loc[frame["top"]].to_numpy()
    return frame.assign(top=firsts[now], sum=total[now], size=size[now])


def isotonic_fit(points: DataFrame, *, increasing: bool = True, parts: int | None = None) -> DataFrame:
    """(score, fit): weighted least squares fit of `label` that never falls (or never rises) with `score`, one row per distinct
    score.

    points: score, label, weight. Points of one score count as one of their summed weight. Rows with a null score, label
    or weight, or a weight of 0, are left out. An empty table gives an empty one. `parts` fixes the number of ranges.
    """
    sign = 1.0 if increasing else -1.0
    value, weight = F.col("label").cast("double"), F.col("weight").cast("double")
    whole = points.where((F.col("weight") > 0) & F.col("label").isNotNull() & F.col("score").isNotNull())
    counts = whole.groupBy((F.col("score").cast("double") * sign).alias("key")).agg(F.sum(value * weight).alias("total"), F.sum(weight).alias("weight"))
    ranged = counts.repartitionByRange(*([parts] if parts else []), "key").sortWithinPartitions("key").withColumn("part", F.spark_partition_id().cast("bigint"))
    rows = kept(ranged.mapInPandas(_pools, "key double, total double, weight double, part bigint, own bigint"), "isotonic-points")
    # a row per pool of a range: `top` names the pool it belongs to by now, whose sums it carries, `part` the range by now
    schema = "part bigint, own bigint, top bigint, sum double, size double"
    pools = rows.groupBy("part", "own").agg(F.sum("total").alias("sum"), F.sum("weight").alias("size")).select("part", "own", F.col("own").alias("top"), "sum", "size")
    mean, order, final = F.col("sum") / F.col("size"), Window.orderBy("part"), []
    while True:
        pools = kept(pools, "isotonic-pools")
        ends = pools.groupBy("part").agg(F.min(mean).alias("first"), F.max(mean).alias("last"))  # a row per range
        above, below = F.min("first").over(order.rowsBetween(1, Window.unboundedFollowing)), F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
        borders = ends.select("part", above.alias("above"), below.alias("below"))
        contested = F.coalesce(mean > F.col("above"), F.lit(False)) | F.coalesce(mean < F.col("below"), F.lit(False))
        marked = kept(pools.join(F.broadcast(borders), "part").withColumn("open", contested), "isotonic-marked")
        final.append(marked.where(~F.col("open")).select("own", mean.alias("fit")))
        left = marked.where("open").select(F.expr("part div 2").alias("part"), "own", "top", "sum", "size")
        if left.isEmpty():
            break
        pools = left.groupBy("part").applyInPandas(_merged, schema)
    fits = functools.reduce(DataFrame.unionByName, final)
    return rows.join(fits, "own").select((F.col("key") * sign).alias("score"), "fit")
