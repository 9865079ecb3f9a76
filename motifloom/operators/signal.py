"""Window sums of attribution tracks, their null model and thresholds.

Tracks are long rows (example, pos, attr). Thresholds come from a few aggregates; the scalars that reach the driver are
single numbers, never rows of tracks.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept
from .isotonic import isotonic_fit


def window_sums(track: DataFrame, window: int, *, by: str = "example", pos: str = "pos", value: str = "attr", width: int = 65_536) -> DataFrame:
    """Sums of all whole windows of a track with places 0, 1, ...: (by, pos, score).

    A track is cut into ranges of places, each with the first window - 1 rows of the next one, so a track that holds a third
    of all rows is dealt over tasks; one shuffle by example and range.
    """
    width = max(width, window)
    rows = track.select(by, pos, F.col(value).alias("_value"), F.floor(F.col(pos) / width).alias("_range"))
    halo = F.pmod(F.col(pos), F.lit(width)) < window - 1
    rows = rows.withColumn("_to", F.explode(F.when(halo, F.array("_range", F.col("_range") - 1)).otherwise(F.array("_range"))))
    frame = Window.partitionBy(by, "_to").orderBy(pos).rowsBetween(0, window - 1)
    found = rows.select(by, pos, "_range", "_to", F.sum("_value").over(frame).alias("score"), F.count(F.lit(1)).over(frame).alias("_n"))
    return found.where((F.col("_n") == window) & (F.col("_range") == F.col("_to"))).select(by, pos, "score")


def percentile_thresholds(scores: DataFrame, share: float) -> DataFrame:
    """(positive, negative): plus and minus the percentile of the absolute scores that `share` of them exceed."""
    q = percentiles(scores, F.abs(F.col("score")), [1 - share])
    return q.select(F.col("q")[0].alias("positive"), (-F.col("q")[0]).alias("negative"))


def passing_share(scores: DataFrame, positive: float, negative: float) -> DataFrame:
    hit = (F.col("score") >= positive) | (F.col("score") <= negative)
    return scores.agg(F.count_if(hit).alias("passing"), F.count(F.lit(1)).alias("n"), F.avg(hit.cast("int")).alias("share"))


def mode_bin(values: DataFrame, bins: int = 1000, value: str = "score") -> DataFrame:
    """(lo, hi, centre) of the fullest of equal bins, the lowest on ties; an empty range gives its only value."""
    v = F.col(value).cast("double")
    ends = values.agg(F.min(v).alias("least"), F.max(v).alias("most"))  # one row
    width = (F.col("most") - F.col("least")) / bins
    binned = values.crossJoin(F.broadcast(ends)).withColumn("bin", F.when(F.col("most") == F.col("least"), F.lit(0)).otherwise(F.least(F.floor((v - F.col("least")) / width), F.lit(bins - 1))))
    counts = binned.groupBy("bin", "least", "most").agg(F.count(F.lit(1)).alias("n"))
    best = counts.agg(F.max(F.struct("n", -F.col("bin"))).alias("top"), F.first("least").alias("least"), F.first("most").alias("most"))
    at = -F.col("top")["col2"]
    return best.select((F.col("least") + at * width).alias("lo"), (F.col("least") + (at + 1) * width).alias("hi"), F.col("top.n").alias("n")).withColumn("centre", (F.col("lo") + F.col("hi")) / 2)


def two_level_mode(values: DataFrame, bins: int = 1000, value: str = "score") -> float:
    """The mode by bins, refined inside the fullest bin."""
    first = mode_bin(values, bins, value).first()
    inside = values.where((F.col(value) > first.lo) & (F.col(value) < first.hi))
    second = mode_bin(inside, bins, value).first()
    return first.centre if second is None or second.n is None else second.centre


def laplace_rates(values: DataFrame, mu: float, value: str = "score") -> DataFrame:
    """(side, rate, n): the steepest of 19 exponential rates through the percentiles 5..95 of each side of mu."""
    shares = [round(0.05 * k, 2) for k in range(1, 20)]
    table = distribution(values, F.col(value))
    v, n = F.col("v"), F.col("n")
    below, above, total = (x or 0 for x in table.agg(F.sum(F.when(v <= mu, n)), F.sum(F.when(v >= mu, n)), F.sum(n)).first())
    sides = []
    for side, size, at in (("negative", below, lambda k: mu - _at(below - 1 - k)), ("positive", above, lambda k: _at(total - above + k) - mu)):
        rates = F.zip_with("q", F.array(*[F.lit(-math.log(1 - p)) for p in shares]), lambda d, e: F.when(d > 0, e / d))
        sides.append(_percentiles(table, size, shares, at).select(F.lit(side).alias("side"), F.array_max(rates).alias("rate"), "n"))
    return sides[0].unionByName(sides[1])


def null_draws(n: int = 10_000, seed: int = 1234) -> np.ndarray:
    """The fixed uniform pairs that null samples are made of."""
    draw = np.random.RandomState(seed)
    return np.stack([draw.uniform(size=n), draw.uniform(size=n)], axis=1)


def laplace_null(spark, mu: float, positive_rate: float, negative_rate: float, positive_share: float, n: int = 10_000, seed: int = 1234) -> DataFrame:
    """(draw, score): values of the two-sided exponential null model, from fixed uniforms."""
    pairs = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(null_draws(n, seed))], "draw int, side double, u double")
    return pairs.select("draw", null_value(F.col("side"), F.col("u"), mu, positive_rate, negative_rate, positive_share).alias("score"))


def null_value(side: Column, u: Column, mu: float, positive_rate: float, negative_rate: float, positive_share: float) -> Column:
    return F.when(side < positive_share, mu - F.log(1 - u) / positive_rate).otherwise(mu + F.log(1 - u) / negative_rate)


def isotonic_precision(observed: DataFrame, null: DataFrame, *, increasing: bool, min_share: float = 0.95) -> DataFrame:
    """(score, fit, precision) of the distinct observed values of one sign.

    A weighted isotonic fit of "observed, not null" on the value; the fit at the weakest value stands for the share of nulls
    among the observed ones and turns fits into precisions; the strongest value gets 1.
    """
    n1, n2 = observed.count(), null.count()
    if not n1 or not n2:
        return observed.select(F.col("score").cast("double"), F.lit(None).cast("double").alias("fit"), F.lit(None).cast("double").alias("precision")).limit(0)
    seen = observed.groupBy(F.col("score").cast("double").alias("score")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    rows = seen.select("score", F.lit(1.0).alias("label"), "weight").unionByName(null.select(F.col("score").cast("double"), F.lit(0.0).alias("label"), F.lit(n1 / n2).alias("weight")))
    fits = kept(isotonic_fit(rows, increasing=increasing).join(seen.select("score"), "score", "left_semi"), "isotonic-fits")
    order = 1 if increasing else -1
    ends = fits.agg(F.min_by("fit", F.col("score") * order).alias("p0"), F.max(F.col("score") * order).alias("strongest")).first()
    p0 = max(ends.p0, 1e-7)
    share = min(max(-1 / (1 - 1 / p0), min_share), 1.0) if p0 < 1 else min_share
    precision = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 + share * (1 - 1 / F.greatest("fit", F.lit(1e-7)))))
    return fits.withColumn("precision", F.when(F.col("score") * order == ends.strongest, F.lit(1.0)).otherwise(precision))


def fdr_threshold(precisions: DataFrame, target_fdr: float, *, increasing: bool) -> float | None:
    """The weakest value whose precision reaches 1 - target_fdr; None where no value does."""
    good = precisions.where(F.col("precision") >= 1 - target_fdr)
    found = good.agg((F.min if increasing else F.max)("score").alias("t")).first()
    return found.t


def refined_thresholds(scores: DataFrame, positive: float | None, negative: float | None, least: float, most: float) -> tuple[float, float]:
    """Thresholds whose passing share lies in [least, most]; else the matching percentiles of the absolute scores."""
    far = float("inf")
    positive, negative = far if positive is None else positive, -far if negative is None else negative
    share = passing_share(scores, positive, negative).first().share or 0.0
    if share < least or share > most:
        found = percentile_thresholds(scores, least if share < least else most).first()
        return found.positive, found.negative
    return positive, negative


def ecdf_rank(scores: DataFrame, threshold: float) -> float:
    """The share of absolute scores below a threshold."""
    found = scores.agg(F.count_if(F.abs("score") < threshold).alias("below"), F.count(F.lit(1)).alias("n")).first()
    return found.below / found.n if found.n else 0.0


def ecdf_value(scores: DataFrame, rank: float) -> float:
    """The absolute score at a weak rank."""
    table = distribution(scores, F.abs(F.col("score")))
    n = table.agg(F.sum("n")).first()[0] or 0
    return table.agg(_at(min(max(int(rank * n), 0), n - 1)).alias("v")).first().v


def distribution(values: DataFrame, value: Column) -> DataFrame:
    """(v, n, before): each distinct value, how often it occurs and how many lie below it.

    Counts per value are ranged over tasks, written, and summed inside the ranges; only the ranges' totals, one a task, are summed
    in one place. So no task holds all values, as an exact percentile in one aggregation would.
    """
    counts = values.select(value.cast("double").alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    ranged = kept(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "ranged")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    offsets = ranged.groupBy("part").agg(F.sum("n").alias("_n")).select("part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_offset") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    return ranged.join(F.broadcast(offsets), "part").select("v", "n", before.alias("before"))


def _at(place: int) -> Column:
    """Over a distribution: the value at a place of the sorted rows, from 0."""
    return F.max(F.when((F.col("before") <= place) & (F.col("before") + F.col("n") > place), F.col("v")))


def percentiles(values: DataFrame, value: Column, shares: list[float]) -> DataFrame:
    """One row (q, n): the exact percentiles of a value, straight lines between neighbours; q is null without values."""
    table = distribution(values, value)
    return _percentiles(table, table.agg(F.sum("n")).first()[0] or 0, shares, _at)


def _percentiles(table: DataFrame, n: int, shares: list[float], at: Callable[[int], Column]) -> DataFrame:
    """One row (q, n) from a distribution, of the n values that `at` finds by their places from 0."""
    parts = []
    for share in shares if n else ():
        place = (n - 1) * share
        low, high = math.floor(place), math.ceil(place)
        parts.append(at(low) if low == high else (high - place) * at(low) + (place - low) * at(high))
    q = F.array(*parts) if parts else F.lit(None).cast("array<double>")
    return table.agg(q.alias("q"), F.lit(n).cast("long").alias("n")) if parts else table.sparkSession.range(1).select(q.alias("q"), F.lit(0).cast("long").alias("n"))
