"""Statistics of patterns: long rows (pattern, pos, base, ...) aggregated by pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def position_means(members: DataFrame, *by: str, value: str) -> DataFrame:
    """Mean and support per position of aligned members, from long rows."""
    return members.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).withColumn("mean", F.col("total") / F.col("n"))


def background(members: DataFrame, hit: str = "hit") -> DataFrame:
    """Share of each base over all members and positions."""
    counts = members.groupBy("base").agg(F.sum(hit).alias("hits"))
    return counts.withColumn("share", F.col("hits") / F.sum("hits").over(Window.partitionBy()))  # four rows


def information(ppm: DataFrame, q: Column, *by: str, p: str = "mean", pseudocount: float = 0.001) -> DataFrame:
    """Information content per position of a long probability matrix against a background column q."""
    c = pseudocount
    term = F.col(p) * F.log2((F.col(p) + c) / (1 + 4 * c)) - q * F.log2(q)
    return ppm.groupBy(*by).agg(F.sum(term).alias("ic"))


def best_window(ic: DataFrame, window: int, by: str = "pattern") -> DataFrame:
    """(by, start_pos, ic): the window of positions with the most information, the first on ties."""
    frame = Window.partitionBy(by).orderBy("pos").rowsBetween(0, window - 1)
    sums = ic.select(by, "pos", F.round(F.sum("ic").over(frame), 9).alias("s"), F.count(F.lit(1)).over(frame).alias("n")).where(F.col("n") == window)
    return sums.groupBy(by).agg(F.max(F.struct("s", (-F.col("pos")).alias("p"))).alias("t")).select(by, (-F.col("t.p")).alias("start_pos"), F.col("t.s").alias("ic"))


def support_range(counts: DataFrame, share: float, least: int, by: str = "pattern") -> DataFrame:
    """(by, first_pos, last_pos) where support reaches min(least, share * the highest support)."""
    top = F.max("n").over(Window.partitionBy(by))
    return counts.withColumn("need", F.least(F.lit(float(least)), top * share)).where("n >= need").groupBy(by).agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
