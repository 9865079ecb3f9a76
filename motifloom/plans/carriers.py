"""Views of general tables that carry sequence-like data, so that every operator runs on whole tables.

mat      embeddings: 64 numbers are 16 positions x 4 bases; h = floor(x * 1e6); the letter of a position is the base
         with the largest |h| (lowest base on ties); label is a cluster.
signal   events: one track per user in time order; the value, negative for errors.
letters  documents: the code points of a text modulo 4, with a small importance per position.
peaks, seqlets  orders and lineitem as genomic intervals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.seqlets import ranged_ordinals

WIDTH = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, hyp array<array<bigint>>, letters array<int>, contrib array<array<bigint>>."""
    flat = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1e6).cast("bigint"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", flat.alias("flat"))
    hyp = F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda p: F.slice("flat", p * 4 + 1, F.lit(4)))
    rows = rows.select("vec_id", "label", hyp.alias("hyp"))

    def letter(row):
        size = F.transform(row, lambda x: F.abs(x))
        return (F.array_position(size, F.array_max(size)) - 1).cast("int")

    rows = rows.withColumn("letters", F.transform("hyp", letter))
    contrib = F.zip_with("letters", "hyp", lambda b, row: F.transform(row, lambda x, i: F.when(i == b, x).otherwise(F.lit(0).cast("bigint"))))
    return rows.withColumn("contrib", contrib)


def mat_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, pos, base, h, hit (1 at the letter), contrib."""
    rows = mat(spark, sf_dir).select("vec_id", "label", F.posexplode(F.arrays_zip("letters", "hyp")).alias("pos", "x"))
    rows = rows.select("vec_id", "label", "pos", F.col("x.letters").alias("letter"), F.posexplode("x.hyp").alias("base", "h"))
    return rows.withColumn("hit", (F.col("base") == F.col("letter")).cast("int")).withColumn("contrib", F.col("h") * F.col("hit"))


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """example, pos, attr decimal(18,2)."""
    value = F.col("value").cast("decimal(18,2)")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("example"), "ts", "event_id", F.when(F.col("event_type") == "error", -value).otherwise(value).alias("attr"))
    numbered = ranged_ordinals(rows, "example", ("ts", "event_id"), "pos")
    return numbered.select("example", F.col("pos").cast("int").alias("pos"), "attr")


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("chrom"), (o * 1000).alias("start_pos"), (o * 1000 + 500).alias("end_pos"), F.col("o_orderpriority").alias("score"), o.alias("ord"))


def seqlets(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("l_linenumber") * 10
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("example_idx"), start.cast("int").alias("start_pos"), (start + F.col("l_quantity").cast("int")).cast("int").alias("end_pos"),
        (F.col("l_returnflag") == "R").alias("is_revcomp"), F.col("l_suppkey").alias("suppkey"), F.col("l_partkey").alias("partkey"), F.col("l_extendedprice").alias("price"),
    )


# SQL twins of the views, as common table expressions
MAT = """cells as (select vec_id, label, cast((i - 1) // 4 as integer) pos, cast((i - 1) % 4 as integer) base,
  cast(floor(cast(embedding[i] as double) * 1e6) as bigint) h from (select *, unnest(range(1, 65)) i from embeddings)),
mat as (select *, case when base = first_value(base) over (partition by vec_id, pos order by abs(h) desc, base) then 1 else 0 end hit from cells)"""
SIGNAL = """sig as (select user_id example, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as integer) pos,
  case when event_type = 'error' then -cast(value as decimal(18,2)) else cast(value as decimal(18,2)) end attr from events)"""
WINDOWS = SIGNAL + """, win as (select example, pos, s score from (select example, pos,
  cast(sum(attr) over w as decimal(28,2)) s, count(*) over w n from sig window w as (partition by example order by pos rows between current row and 4 following)) where n = 5)"""
SEQLETS = """seqlets as (select l_orderkey example_idx, cast(l_linenumber * 10 as integer) start_pos, cast(l_linenumber * 10 + cast(l_quantity as integer) as integer) end_pos,
  l_returnflag = 'R' is_revcomp, l_suppkey suppkey, l_partkey partkey, l_extendedprice price from lineitem)"""
PEAKS = """peaks as (select o_orderstatus chrom, o_orderkey * 1000 start_pos, o_orderkey * 1000 + 500 end_pos, o_orderpriority score, o_orderkey ord from orders)"""
