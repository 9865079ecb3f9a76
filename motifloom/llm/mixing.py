"""Mixing sources to target weights.

Every row gets a hash-random key. Rows are range-sorted within their source by that key: the leading bits of the key
name a range, and distributed prefix sums over the ranges (a few numbers per source and range) tell which range each
source's budget ends in. Only the rows of those ranges are then sorted and summed one by one; all other rows are taken
whole or not at all. No source, however large, is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, body, written


def n_words(text: str = "text") -> Column:
    return F.regexp_count(body(text), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """source, source_size -> target: `share` of all sizes dealt by weight, each at most `most` times its source's size.

    The excess of capped sources goes to the others by weight until none is above its cap. Sorted by cap per weight,
    the capped sources are the first ones, so the level that the others reach comes from running sums.
    """
    nth = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(nth) - 1, F.lit(len(weights))) + 1)
    ranked = sizes.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total, all_weights = (F.sum(c).over(Window.partitionBy()) for c in ("source_size", "weight"))
    ranked = ranked.withColumn("level", (F.lit(float(share)) * total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (all_weights - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    # the first source whose cap is above the level sets it for itself and all later ones
    fits = F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("level"))
    level = F.first(fits, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return ranked.select("source", "source_size", F.coalesce(F.least(level * F.col("weight"), "cap"), "cap").alias("target"))


def _mixed(docs: DataFrame, doc_id: str, text: str, source: str, weights: tuple[int, ...], share: float, most: float, seed: str, range_rows: int) -> DataFrame:
    """id, source, print (a hash of the text), size, source_size, target, taken of every row."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(source).alias("source"), F.xxhash64(body(text)).alias("print"), n_words(text).alias("size"))
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("id").cast("string"), F.lit("null"))))
    rows = written(rows.withColumn("key", key), "mix-rows")
    wanted = rows.count() / range_rows
    digits = next((d for d in range(1, 4) if 16**d >= wanted), 4)
    rows = rows.withColumn("range", F.conv(F.substring("key", 1, digits), 16, 10).cast("int"))
    ranges = written(rows.groupBy("source", "range").agg(F.sum("size").alias("words")), "mix-ranges")
    targets = source_targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    targets = targets.withColumn("budget", F.floor("target").cast("long"))
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0).cast("long")))
    targets = targets.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    prefix = F.sum("words").over(Window.partitionBy("source").orderBy("range")) - F.col("words")
    plan = ranges.withColumn("before", prefix).withColumnRenamed("source", "s").join(targets, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    plan = plan.select(F.col("source").alias("s"), F.col("range").alias("r"), "source_size", "target", "epochs", (F.col("rest") - F.col("before")).alias("left"), "words")
    found = rows.join(written(plan, "mix-plan"), F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    cut = (F.col("left") > 0) & (F.col("left") < F.col("words"))
    whole = found.where(~cut).withColumn("part", F.when(F.col("left") > 0, F.col("size")).otherwise(F.lit(0).cast("long")))
    within = Window.partitionBy("source", "range").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("size").over(within), F.lit(0))
    partly = found.where(cut).withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - ahead)).cast("long"))
    taken = (F.col("epochs") * F.col("size") + F.col("part")).alias("taken")
    return whole.unionByName(partly).select("id", "source", "print", "size", "source_size", "target", taken)


def mix_sources(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix", range_rows: int = 2000
) -> DataFrame:
    """How many words of every row the mix takes.

    Returns doc_id, size, source_size, target, taken, one row per input row. Sources in code point order, null last,
    weigh `weights` in turn. A source's budget is its target rounded down; it takes whole epochs of the source first
    and then rows in key order up to the exact budget, the last of them in part, so no row exceeds its epochs plus one.
    Null or empty texts have size 0 and take 0. Rows that repeat an id share a key and are then ordered by size. Reruns
    agree: keys depend on `seed` and the id only. An empty table gives an empty result; other columns are ignored. Ranges
    are as many as hold about range_rows rows each, 65536 a source at most.
    """
    rows = _mixed(docs, doc_id, text, source, weights, share, most, seed, range_rows)
    return rows.select(F.col("id").alias(doc_id), "size", "source_size", "target", "taken")


def mixed_documents(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", n_chars: str = "n_chars",
    weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix", range_rows: int = 2000,
) -> DataFrame:
    """The mix itself, with the columns of docs, whatever their names: a row for each epoch that takes a document whole,
    and one with its first words where the budget ends inside it, joined by single spaces.

    Rows of which nothing is taken go, so do null and empty texts. Rows that repeat id, source and text share what the
    mix takes of them evenly; the first ones by their other columns get the odd words. An empty table gives an empty one.
    """
    plan = _mixed(docs, doc_id, text, source, weights, share, most, seed, range_rows)
    name = F.to_json(F.struct("id", "source", "print"))
    plan = plan.groupBy(name.alias("name")).agg(F.max("size").alias("size"), F.sum("taken").alias("total"), F.count(F.lit(1)).alias("copies")).where("total > 0")
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("id"), F.col(source).alias("source"), F.xxhash64(body(text)).alias("print"))
    rows = rows.select("row", name.alias("name")).join(plan, "name")
    others = [F.col("row")[c] for c, kind in docs.dtypes if c not in (doc_id, text, source) and "map<" not in kind and kind != "variant"]
    nth = F.row_number().over(Window.partitionBy("name").orderBy("name", *others))
    rows = rows.withColumn("nth", nth).withColumn("taken", F.expr("total div copies + if(nth <= total % copies, 1, 0)"))
    epochs = F.expr("filter(concat(array_repeat(size, cast(taken div size as int)), array(taken % size)), x -> x > 0)")
    rows = rows.select("row", "size", F.explode(epochs).alias("words"))
    cut = F.col("words") < F.col("size")
    first = F.slice(F.regexp_extract_all(F.col("row")[text], F.lit(WORD), F.lit(0)), F.lit(1), F.col("words").cast("int"))
    rows = rows.select("row", F.when(cut, F.array_join(first, " ")).otherwise(F.col("row")[text]).alias("cut_text"), cut.alias("cut"))
    new = {text: F.col("cut_text")}
    if n_chars in docs.columns:
        new[n_chars] = F.when(F.col("cut"), F.length("cut_text").cast(docs.schema[n_chars].dataType)).otherwise(F.col("row")[n_chars])
    return rows.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
