"""From neighbour lists to a weighted graph: distances, symmetry, density adaptation, conditional probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tracks import perplexity_beta, sim_to_distance


def symmetrise(edges: DataFrame, value: str) -> DataFrame:
    """Average of the directions that exist, in both directions."""
    back = edges.select(F.col("j").alias("i"), F.col("i").alias("j"), value)
    return edges.select("i", "j", value).unionByName(back).groupBy("i", "j").agg(F.avg(value).alias(value))


def distances(edges: DataFrame) -> DataFrame:
    """(i, j, d) with d = ln(2 / sim - 1) > 0; equal rows (d = 0) are no edges."""
    return edges.select("i", "j", sim_to_distance(F.col("sim")).alias("d")).where("d > 0")


def precisions(edges: DataFrame, perplexity: float) -> DataFrame:
    """(i, beta) by bisection on each row's distances, as one expression per row."""
    rows = edges.groupBy("i").agg(F.array_sort(F.collect_list("d")).alias("ds"))
    return rows.select("i", perplexity_beta(F.col("ds"), perplexity).alias("beta"))


def density_weights(edges: DataFrame, betas: DataFrame) -> DataFrame:
    """(src, dst, weight): sqrt of both ends' shares exp(-d / beta) / Z, and 1 / Z on the diagonal.

    edges: symmetric (i, j, d); betas: (i, beta) of every row, also of rows without edges.
    """
    rows = edges.join(betas, "i").withColumn("e", F.exp(-F.col("d") / F.col("beta")))
    z = betas.select("i").join(rows.groupBy("i").agg((1 + F.sum("e")).alias("z")), "i", "left").select("i", F.coalesce("z", F.lit(1.0)).alias("z"))
    share = rows.join(z, "i").select("i", "j", (F.col("e") / F.col("z")).alias("p"))
    other = share.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("p").alias("q"))
    pairs = share.join(other, ["i", "j"]).select(F.col("i").alias("src"), F.col("j").alias("dst"), F.sqrt(F.col("p") * F.col("q")).alias("weight"))
    return pairs.unionByName(z.select(F.col("i").alias("src"), F.col("i").alias("dst"), (1 / F.col("z")).alias("weight")))


def conditional_probabilities(knn: DataFrame, perplexity: float) -> DataFrame:
    """(i, j, p): neighbours 1..int(3 * perplexity + 1) without self, exp(-d * beta) normalised per row, both ways added
    and divided by the total."""
    k = int(3 * perplexity + 1)
    near = knn.where(F.col("i") != F.col("j")).withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("sim"), "j"))).where(F.col("r") <= k)
    rows = near.select("i", "j", sim_to_distance(F.col("sim")).alias("d"))
    weights = rows.join(precisions(rows, perplexity), "i").withColumn("w", F.exp(-F.col("d") * F.col("beta")))
    p = weights.select("i", "j", (F.col("w") / F.sum("w").over(Window.partitionBy("i"))).alias("p"))
    both = p.unionByName(p.select(F.col("j").alias("i"), F.col("i").alias("j"), "p")).groupBy("i", "j").agg(F.sum("p").alias("p"))
    total = both.agg(F.sum("p").alias("total"))  # one row
    return both.crossJoin(F.broadcast(total)).select("i", "j", (F.col("p") / F.col("total")).alias("p"))


def modularity(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(q): modularity of a partition (node, community) of stored edges (src, dst, weight); each stored entry is an
    edge, so a symmetric pair counts twice and a self-loop once."""
    of = lambda c: membership.select(F.col("node").alias(c), F.col("community").alias(f"{c}_community"))
    rows = edges.join(of("src"), "src").join(of("dst"), "dst")
    inside = rows.groupBy(F.col("src_community").alias("c")).agg(F.sum(F.when(F.col("src_community") == F.col("dst_community"), F.col("weight")).otherwise(0.0)).alias("inside"), F.sum("weight").alias("out"))
    into = rows.groupBy(F.col("dst_community").alias("c")).agg(F.sum("weight").alias("into"))
    total = rows.agg(F.sum("weight").alias("m"))  # one row
    parts = inside.join(into, "c", "full").crossJoin(F.broadcast(total))
    share = F.coalesce("inside", F.lit(0.0)) / F.col("m") - F.pow((F.coalesce("out", F.lit(0.0)) + F.coalesce("into", F.lit(0.0))) / (2 * F.col("m")), F.lit(2))
    return parts.agg(F.sum(share).alias("q"))
