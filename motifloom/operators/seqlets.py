"""Seqlets: picking, strand, trimming, expansion and bounds; rows of coordinates that join tracks when read."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tracks as T
from ..sources.shared import kept


def mask_scores(scores: Column, positive: float, negative: float, flank: int) -> Column:
    """Absolute scores where they pass a threshold and lie `flank` off both ends, null elsewhere; flank 0 masks none."""
    keep = lambda x, i, n: ((x >= positive) | (x <= negative)) & (i >= flank) & (i < n - flank)
    return T.let(scores, lambda s: T.let(F.size(s), lambda n: F.transform(s, lambda x, i: F.when(keep(x, i, n), F.abs(x)))))


def pick_seqlets(tracks: DataFrame, window: int, flank: int, suppress: int, positive: float, negative: float, *, example: str = "example", attr: str = "attr") -> DataFrame:
    """(example, pick, pos, start_pos, end_pos, score) from rows (example, attr array): narrow, one row per example.

    Sums are rounded to nine digits, so that equal windows tie whatever the order of addition.
    Greedy from the highest masked window sum of each example; a pick covers its window and `flank` on both sides.
    """
    sums = F.transform(T.sliding_sums(F.col(attr), window), lambda x: F.round(x, 9))
    rows = tracks.select(example, F.posexplode(T.pick_peaks(mask_scores(sums, positive, negative, flank), flank, suppress)).alias("pick", "p"))
    at = F.col("p.pos")
    return rows.select(example, "pick", at.alias("pos"), (at - flank).alias("start_pos"), (at + window + flank).alias("end_pos"), F.col("p.score").alias("score"))


def ranged_ordinals(rows: DataFrame, by: str, order: tuple[str | Column, ...], name: str, *, most: int | None = None) -> DataFrame:
    """Number rows 0, 1, ... within each value of `by`; with `most`, only the rows numbered below it.

    Rows are ranged by (by, order), so a value that holds a third of all rows is numbered in many tasks, each from the count of
    what lies before. Only values that start in an earlier range need that count, at most one a range.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = kept(rows.repartitionByRange(by, *keys).withColumn("_part", F.spark_partition_id()), "ranged-rows")
    sizes = ranged.groupBy(F.col(by).alias("_by"), F.col("_part").alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_by").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.withColumn("_before", before).where("_before > 0").drop("_n")
    found = ranged.join(F.broadcast(starts), F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_at")), "left")
    start = F.coalesce("_before", F.lit(0))
    found = found.where(start < most) if most is not None else found
    nth = F.row_number().over(Window.partitionBy(by, "_part").orderBy(*keys))
    inside = found.withColumn("_nth", nth)
    inside = inside.where(F.col("_nth") <= most) if most is not None else inside  # a limit of the ranking
    numbered = inside.withColumn(name, start + F.col("_nth") - 1)
    return (numbered.where(F.col(name) < most) if most is not None else numbered).select(*rows.columns, name)


_OPEN = "by string, pos bigint, score double, picked boolean"


def _greedy(suppress: int):
    """Over rows (by, range, own, picked, pos, score), each range's best first: the rows of the range that are picked, and those
    that a row outside may still decide. Places are kept in buckets of which each holds one pick at most."""
    wide = suppress + 1

    def run(frames):
        key, picks, least, last = None, {}, {}, {}
        for frame in frames:
            out = []
            for by, part, own, picked, pos, score in frame.itertuples(index=False, name=None):
                if (by, part) != key:
                    key, picks, least, last = (by, part), {}, {}, {}
                at = pos // wide
                if picked:
                    picks[at] = pos
                    continue
                if any(k in picks and abs(picks[k] - pos) <= suppress for k in (at - 1, at, at + 1)):
                    continue
                open_ = not own or at in last or last.get(at - 1, pos - wide) >= pos - suppress or least.get(at + 1, pos + wide) <= pos + suppress
                if open_:
                    least[at], last[at] = min(pos, least.get(at, pos)), max(pos, last.get(at, pos))
                else:
                    picks[at] = pos
                if own:
                    out.append((by, pos, score, not open_))
            yield pd.DataFrame(out, columns=["by", "pos", "score", "picked"])

    return run


def greedy_picks(rows: DataFrame, suppress: int, *, width: int = 65_536) -> DataFrame:
    """(example, pos, score) of the rows that picking the best and dropping all within `suppress` of it, over and over, picks.

    rows: example, pos, score, one row a place, the best score first and the lowest place on ties. A track is cut into
    ranges of places with a halo of `suppress`. A row is picked where no better one within reach is undecided, which a
    range settles for all rows but those that hang on a better row across its border; these go on to the next round, with
    the picks at the border. Each round decides at least the best row left, in practice nearly all.
    """
    width = max(width, suppress + 1)
    # the example travels as text, so that it may have any type
    given = rows.select(F.col("example").cast("string").alias("by"), F.col("pos").cast("bigint"), F.col("score").cast("double"), F.lit(False).alias("picked"))
    state, done = kept(given, "candidates"), []
    part, inside = F.floor(F.col("pos") / width), F.pmod("pos", F.lit(width))
    ahead, behind = inside < suppress, inside >= width - suppress
    while True:
        near = F.filter(F.array(F.struct(part.alias("part"), F.lit(True).alias("own")), F.struct(F.when(ahead, part - 1).alias("part"), F.lit(False).alias("own")), F.struct(F.when(behind, part + 1).alias("part"), F.lit(False).alias("own"))), lambda x: x["part"].isNotNull())
        dealt = state.withColumn("to", F.explode(near)).select("by", "to.part", "to.own", "picked", "pos", "score").repartition("by", "part").sortWithinPartitions("by", "part", F.desc("picked"), F.desc("score"), "pos")
        found = kept(dealt.mapInPandas(_greedy(suppress), _OPEN), "picks")
        done.append(found.where("picked"))
        left = found.where(~F.col("picked"))
        if left.isEmpty():
            break
        border = functools.reduce(DataFrame.unionByName, done).where(ahead | behind)
        state = kept(left.unionByName(border), "candidates")
    kind = rows.schema["example"].dataType
    return functools.reduce(DataFrame.unionByName, done).select(F.col("by").cast(kind).alias("example"), "pos", "score")


def pick_long(scores: DataFrame, window: int, flank: int, suppress: int, positive: float, negative: float, *, width: int = 65_536) -> DataFrame:
    """The seqlets of pick_seqlets from long rows (example, pos, score) of all windows, places 0, 1, ... in each example, so that
    a track of any length is dealt over tasks."""
    sizes = kept(scores.groupBy(F.col("example").alias("_example")).agg((F.max("pos") + 1).alias("_n")), "track-sizes")
    sizes = F.broadcast(sizes) if sizes.count() <= 1_000_000 else sizes  # 16 bytes a row
    score = F.col("score").cast("double")
    passing = scores.where(((score >= positive) | (score <= negative)) & (F.col("pos") >= flank))
    inside = passing.join(sizes, F.col("example").eqNullSafe(F.col("_example"))).where(F.col("pos") < F.col("_n") - flank)
    picks = greedy_picks(inside.select("example", "pos", F.abs(score).alias("score")), suppress, width=width)
    numbered = ranged_ordinals(picks, "example", (F.desc("score"), "pos"), "pick")
    at = F.col("pos").cast("int")
    return numbered.select("example", F.col("pick").cast("int"), at.alias("pos"), (at - flank).alias("start_pos"), (at + window + flank).alias("end_pos"), "score")


def sign_split(seqlets: DataFrame, core: Column, threshold: float) -> DataFrame:
    """Adds metacluster by the sum over the core: pos above the threshold, neg below its negative; others go."""
    sign = F.when(core > threshold, "pos").when(core < -threshold, "neg")
    return seqlets.withColumn("metacluster", sign).where("metacluster is not null")


def cap(seqlets: DataFrame, most: int, *order: str, by: str = "metacluster") -> DataFrame:
    """The first `most` seqlets of each metacluster in extraction order, numbered by `ord`. Ranges of the order are counted, and
    only those in which a seqlet may come in are ranked."""
    return ranged_ordinals(seqlets, by, order, "ord", most=most)


def trim(seqlets: DataFrame, left: Column, width: Column) -> DataFrame:
    """Cut to `width` positions from `left` of the oriented seqlet; on the reverse strand left means the right end."""
    start = F.when(F.col("is_revcomp"), F.col("end_pos") - left - width).otherwise(F.col("start_pos") + left)
    return seqlets.withColumn("_start", start).withColumn("end_pos", (F.col("_start") + width).cast("int")).withColumn("start_pos", F.col("_start").cast("int")).drop("_start")


def expand(seqlets: DataFrame, left: Column, right: Column, length: Column) -> DataFrame:
    """Grow by flanks of the oriented seqlet and keep what stays inside [0, length]."""
    start = F.col("start_pos") - F.when(F.col("is_revcomp"), right).otherwise(left)
    end = F.col("end_pos") + F.when(F.col("is_revcomp"), left).otherwise(right)
    grown = seqlets.withColumn("_s", start).withColumn("_e", end).where((F.col("_s") >= 0) & (F.col("_e") <= length))
    return grown.withColumn("start_pos", F.col("_s").cast("int")).withColumn("end_pos", F.col("_e").cast("int")).drop("_s", "_e")


def shift(seqlets: DataFrame, by: Column, length: Column) -> DataFrame:
    """Move by an offset of the oriented seqlet; kept where start >= 0 and end < length (strict)."""
    step = F.when(F.col("is_revcomp"), -by).otherwise(by)
    moved = seqlets.withColumn("start_pos", (F.col("start_pos") + step).cast("int")).withColumn("end_pos", (F.col("end_pos") + step).cast("int"))
    return moved.where((F.col("start_pos") >= 0) & (F.col("end_pos") < length))


def distinct_last(seqlets: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], values: tuple[str, ...]) -> DataFrame:
    """One row per key: the place of its first occurrence, the values of its last."""
    row = F.struct(*order, *values)
    return seqlets.groupBy(*keys).agg(F.min(F.struct(*order)).alias("first"), F.max(row).alias("last")).select(*keys, *[F.col(f"first.{c}").alias(f"first_{c}") for c in order], *[F.col(f"last.{c}").alias(c) for c in values])


def absolute(seqlets: DataFrame, window: int) -> DataFrame:
    """Genomic columns of seqlets joined with their peaks: chrom, chrom_start, chrom_end, strand."""
    middle = F.expr("(peak_start + peak_end) div 2") - window // 2
    return seqlets.withColumn("chrom_start", middle + F.col("start_pos") + 1).withColumn("chrom_end", middle + F.col("end_pos")).withColumn("strand", F.when(F.col("is_revcomp"), "-").otherwise("+"))


def with_peaks(seqlets: DataFrame, peaks: DataFrame, chroms: tuple[str, ...] = ("*",)) -> DataFrame:
    """Join with the peaks by their ordinal after the chromosome filter; a seqlet without a peak is an error.

    peaks has chrom, start_pos, end_pos, score and ord, its order in the file. Ordinals are dense over the kept peaks:
    each chromosome range keeps its count, so numbering needs no global sort of the peaks' rows.
    """
    kept = peaks if "*" in chroms else peaks.where(F.col("chrom").isin(*chroms))
    numbered = dense_ordinals(kept.select("chrom", F.col("start_pos").alias("peak_start"), F.col("end_pos").alias("peak_end"), "score", "ord"), "ord", "example_idx")
    found = seqlets.join(numbered.drop("ord"), "example_idx", "left")
    return found.withColumn("chrom", F.coalesce("chrom", F.raise_error(F.concat(F.lit("no peak for example "), F.col("example_idx").cast("string")))))


def dense_ordinals(rows: DataFrame, order: str, name: str, width: int = 65_536) -> DataFrame:
    """Number rows 0, 1, ... by a numeric column: numbers inside ranges of it plus the ranges' running counts."""
    ranged = rows.withColumn("_range", F.floor(F.col(order) / width))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    found = ranged.withColumn("_i", inside).join(sizes.select("_range", before.alias("_before")), "_range")
    return found.withColumn(name, F.col("_before") + F.col("_i")).drop("_range", "_i", "_before")


def pair_ordinals(rows: DataFrame, major: str, minor: str, name: str, width: int = 16_384) -> DataFrame:
    """Number rows 0, 1, ... by two numeric columns, nulls of the first last: numbers inside ranges of the second within a
    value of the first, plus running counts over a value's ranges, over values inside ranges of values, and over those."""
    ahead = lambda *order: Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ahead_in = lambda part, *order: Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    count = lambda over: F.coalesce(F.sum("_n").over(over), F.lit(0))
    ranged = rows.withColumn("_range", F.floor(F.col(minor) / width))
    parts = ranged.groupBy(F.col(major).alias("_major"), F.col("_range").alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    values = parts.groupBy(F.col("_major").alias("_value")).agg(F.sum("_n").alias("_n")).withColumn("_group", F.floor(F.col("_value") / width))
    groups = values.groupBy(F.col("_group").alias("_of")).agg(F.sum("_n").alias("_n"))
    groups = groups.select("_of", count(ahead(F.asc_nulls_last("_of"))).alias("_before_group"))
    values = values.withColumn("_before_value", count(ahead_in("_group", F.asc_nulls_last("_value"))))
    values = values.join(groups, F.col("_group").eqNullSafe(F.col("_of"))).select("_value", (F.col("_before_group") + F.col("_before_value")).alias("_before"))
    parts = parts.withColumn("_before_part", count(ahead_in("_major", "_part"))).join(values, F.col("_major").eqNullSafe(F.col("_value")))
    parts = parts.select("_major", "_part", (F.col("_before") + F.col("_before_part")).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(major, "_range").orderBy(minor)) - 1
    found = ranged.withColumn("_i", inside).join(parts, F.col(major).eqNullSafe(F.col("_major")) & (F.col("_range") == F.col("_part")))
    return found.withColumn(name, F.col("_start") + F.col("_i")).select(*rows.columns, name)
