"""Exact deduplication by skew-safe combining.

Equal texts meet in three steps, and each step groups by the digest *and* the whole text, so that a digest alone never
decides: every task first folds the copies it has read itself (the map side of the first aggregation, whose salt is the
task's number), then the salted digest groups are merged, then the winners of the salts are combined over all tasks. A
text that makes up a third of the corpus therefore reaches the last step as at most `salts` rows.

Rows then find their group by the digest, but only where the groups have shown that all texts of that digest are equal.
Where different texts share a digest, rows meet their group by the whole text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import beside, body, written

RUN = 65_536  # rows that one group of equal rows is written out by at a time


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _keyed(docs: DataFrame, doc_id: str, text: str, digest: Callable[[Column], Column]) -> DataFrame:
    return docs.select(F.col(doc_id).alias("id"), body(text).alias("body")).withColumn("digest", digest(F.col("body")))


def _combined(keyed: DataFrame, salts: int) -> DataFrame:
    salted = keyed.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    winners = salted.groupBy("digest", "salt", "body").agg(F.max("id").alias("id"), F.count(F.lit(1)).alias("n"))
    return winners.groupBy("digest", "body").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"))


def text_groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", salts: int = 64, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per distinct text: digest, body, keep_id (largest id), group_size."""
    return _combined(_keyed(docs, doc_id, text, digest), salts)


def _decided(docs: DataFrame, doc_id: str, text: str, salts: int, digest: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame | None]:
    """(id, digest, text_sha256, copies, keep_id, group_size) of all distinct (id, text), in two tables: those whose
    digest only equal texts have, and, with the column body and None where there are none, those whose digest is shared."""
    keyed = _keyed(docs, doc_id, text, digest)
    named = F.col("digest") if digest is sha256 else sha256(F.col("body"))
    groups = _combined(keyed, salts).select("digest", "body", named.alias("text_sha256"), "keep_id", "group_size")
    plain = written(groups.drop("body"), "exact-groups")
    clashing = written(plain.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest"), "exact-clashes")
    count = F.count(F.lit(1)).alias("copies")
    if clashing.isEmpty():
        return keyed.groupBy("id", "digest").agg(count).join(plain, "digest"), None
    alone = keyed.join(beside(clashing), "digest", "left_anti").groupBy("id", "digest").agg(count).join(plain, "digest")
    shared = keyed.join(beside(clashing), "digest", "left_semi").groupBy("id", "digest", "body").agg(count)
    return alone, shared.join(groups.join(beside(clashing), "digest", "left_semi"), ["digest", "body"])


def exact_dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", salts: int = 64, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Decide for every row which row of its group of equal texts stays.

    Returns doc_id, keep_id, group_size, kept, text_sha256, one row per input row, dropped ones too. The row with the
    largest id stays; of rows that repeat id and text exactly one does. Null text counts as empty, and a null id loses
    to any other. Empty tables give empty results; other columns are ignored, whatever their names.

    Rows that repeat id and text are counted before they are shuffled and written out again at the end. `digest` only
    tells where to look; results do not depend on it.
    """
    alone, shared = _decided(docs, doc_id, text, salts, digest)
    rows = alone if shared is None else alone.unionByName(shared.drop("body"))
    rows = rows.withColumn("run", F.explode(F.expr(f"sequence(0L, (copies - 1) div {RUN})")))
    rows = rows.withColumn("nth", F.explode(F.expr(f"sequence(1L, least({RUN}L, copies - run * {RUN}))")))
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("run") == 0) & (F.col("nth") == 1)
    return rows.select(F.col("id").alias(doc_id), "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def kept_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", salts: int = 64, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The filtering form: the rows of docs that stay, with the columns of docs, whatever their names.

    Of rows that repeat id and text the first one by its other columns stays.
    """
    name = F.concat_ws(":", "digest", F.coalesce(F.col("id").cast("string"), F.lit("null")))
    alone, shared = (None if x is None else x.where(F.col("id").eqNullSafe(F.col("keep_id"))).withColumn("name", name) for x in _decided(docs, doc_id, text, salts, digest))
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("id"), body(text).alias("body")).withColumn("digest", digest(F.col("body")))
    rows = rows.withColumn("name", name).select("row", "body", "name")
    others = [F.col("row")[c] for c, kind in docs.dtypes if c not in (doc_id, text) and "map<" not in kind and kind != "variant"]

    def first(found: DataFrame, *keys: str) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys, *others))
        return found.withColumn("nth", nth).where("nth = 1").select("row.*")

    kept = first(rows.drop("body").join(alone.select("name"), "name", "left_semi"), "name")
    return kept if shared is None else kept.unionByName(first(rows.join(shared.select("name", "body"), ["name", "body"], "left_semi"), "name", "body"))
