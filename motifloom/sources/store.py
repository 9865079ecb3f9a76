"""The results store: a folder of Parquet tables meta, patterns, subpatterns, seqlets, seqlet_values; and the legacy layout.

patterns and subpatterns hold mean matrices, seqlets the members' coordinates, seqlet_values the members' letters and
matrices on their strand. Numbers order patterns; names do so only where a text format asks for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tracks as T
from .legacy import format_seqlet, parse_seqlet

TABLES = ("meta", "patterns", "subpatterns", "seqlets", "seqlet_values")
VALUES = "metacluster string, pattern int, ord int, example_idx bigint, start_pos int, end_pos int, letters array<int>, contrib_scores array<array<double>>, hypothetical_contribs array<array<double>>"


def seqlet_values(members: DataFrame, tracks: DataFrame) -> DataFrame:
    """Per member: letters, contributions and hypothetical contributions on its strand."""
    from ..plans.discovery import hydrate

    double = lambda m: F.transform(m, lambda r: r.cast("array<double>"))
    rows = hydrate(members, tracks).withColumn("hypothetical_contribs", double(F.col("hyp"))).withColumn("letters", F.col("letters").cast("array<int>"))
    rows = rows.withColumn("contrib_scores", T.contributions(F.col("letters"), F.col("hypothetical_contribs")))
    return rows.select("metacluster", "pattern", "ord", "example_idx", "start_pos", "end_pos", "letters", "contrib_scores", "hypothetical_contribs")


def mean_matrices(members: DataFrame, tracks: DataFrame, *by: str) -> DataFrame:
    """by, n_seqlets, sequence, contrib_scores, hypothetical_contribs: means over the members that cover a position."""
    from ..plans.discovery import hydrate

    rows = hydrate(members, tracks).withColumn("contrib", T.contributions(F.col("letters"), F.col("hyp")))
    cells = rows.select(*by, F.posexplode(F.arrays_zip("letters", "contrib", "hyp")).alias("pos", "x"))
    bases = F.transform(F.array(*map(F.lit, range(4))), lambda b: F.struct(b.alias("base"), (F.col("x.letters") == b).cast("double").alias("hit"), F.element_at("x.contrib", b + 1).alias("c"), F.element_at("x.hyp", b + 1).alias("h")))
    long = cells.select(*by, "pos", F.explode(bases).alias("y")).groupBy(*by, "pos", "y.base").agg(F.avg("y.hit").alias("hit"), F.avg("y.c").alias("c"), F.avg("y.h").alias("h"))
    wide = long.groupBy(*by, "pos").agg(F.array_sort(F.collect_list(F.struct("base", "hit", "c", "h"))).alias("z"))
    wide = wide.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "z"))).alias("m"))
    pick = lambda name: F.transform("m", lambda p: F.transform(p["z"], lambda z: z[name]))
    sizes = members.groupBy(*by).agg(F.count(F.lit(1)).alias("n_seqlets"))
    return wide.select(*by, pick("hit").alias("sequence"), pick("c").alias("contrib_scores"), pick("h").alias("hypothetical_contribs")).join(sizes, list(by))


def save(members: DataFrame, tracks: DataFrame, path: str, window_size: int | None = None) -> None:
    """Write a discovery's members as a results store."""
    spark = members.sparkSession
    keys = [("window_size", str(window_size))] if window_size is not None else []
    spark.createDataFrame(keys, "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    mean_matrices(members, tracks, "metacluster", "pattern").write.mode("overwrite").parquet(f"{path}/patterns")
    mean_matrices(members, tracks, "metacluster", "pattern", "subpattern").write.mode("overwrite").parquet(f"{path}/subpatterns")
    members.write.mode("overwrite").parquet(f"{path}/seqlets")
    seqlet_values(members, tracks).write.mode("overwrite").parquet(f"{path}/seqlet_values")


def load(spark: SparkSession, path: str, table: str) -> DataFrame:
    if table not in TABLES:
        raise ValueError(f"no table {table}")
    return spark.read.parquet(f"{path}/{table}")


def window_size(spark: SparkSession, path: str, given: int | None = None) -> int:
    """The window given, else the store's."""
    if given is not None:
        return given
    found = load(spark, path, "meta").where("key = 'window_size'").first()
    if found is None:
        raise ValueError("the store has no window size; give one")
    return int(found.value)


def to_legacy(spark: SparkSession, path: str, out: str, with_subpatterns: bool = False) -> None:
    """The legacy layout as tables: seqlets as text with dummy alignments, patterns per metacluster number.

    Subpatterns were lost on this way; with_subpatterns keeps them.
    """
    number = F.when(F.col("metacluster") == "pos", 0).otherwise(1).alias("metacluster_idx")
    name = F.concat(F.lit("pattern_"), F.col("pattern").cast("string")).alias("pattern_name")
    load(spark, path, "seqlets").select(number, name, "ord", format_seqlet().alias("seqlet"), F.lit(0).alias("alnmt"), *(["subpattern"] if with_subpatterns else [])).write.mode("overwrite").parquet(f"{out}/seqlets_and_alnmts")
    load(spark, path, "patterns").select(number, name, F.col("sequence").alias("sequence_fwd"), F.col("contrib_scores").alias("task0_contrib_scores_fwd"), F.col("hypothetical_contribs").alias("task0_hypothetical_contribs_fwd"), "n_seqlets").write.mode("overwrite").parquet(f"{out}/patterns")
    spark.createDataFrame([("status", "success"), ("total_time_taken", "1.0")], "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{out}/meta")


def from_legacy(spark: SparkSession, path: str, out: str) -> None:
    """The legacy layout's tables back to a results store."""
    group = F.when(F.col("metacluster_idx") == 0, "pos").otherwise("neg").alias("metacluster")
    pattern = F.regexp_extract("pattern_name", r"_(\d+)$", 1).cast("int").alias("pattern")
    rows = spark.read.parquet(f"{path}/seqlets_and_alnmts")
    sub = F.col("subpattern") if "subpattern" in rows.columns else F.lit(0)
    text = rows.select(group, pattern, sub.alias("subpattern"), "ord", "seqlet")
    keys = ("metacluster", "pattern", "subpattern", "ord")
    seqlets = parse_seqlet(text, "seqlet", *keys)
    seqlets.write.mode("overwrite").parquet(f"{out}/seqlets")
    spark.createDataFrame([], VALUES).write.mode("overwrite").parquet(f"{out}/seqlet_values")
    p = spark.read.parquet(f"{path}/patterns")
    p.select(group, pattern, "n_seqlets", F.col("sequence_fwd").alias("sequence"), F.col("task0_contrib_scores_fwd").alias("contrib_scores"), F.col("task0_hypothetical_contribs_fwd").alias("hypothetical_contribs")).write.mode("overwrite").parquet(f"{out}/patterns")
    spark.createDataFrame([], "key string, value string").write.mode("overwrite").parquet(f"{out}/meta")
