"""Queries on whole patterns: text rows, matches, examples, thresholds and discovery end to end."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import tracks as T
from ..operators import matching as M
from ..operators import seqlets as S
from ..operators import signal as G
from . import carriers as V
from . import discovery, report
from .catalogue_tracks import R6, r6

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"with {V.MAT}, c as (select label, pos, base, sum(hit) c from mat group by all), n as (select *, c / cast(sum(c) over (partition by label, pos) as double) p from c) select label, pos, " + ", ".join(f"round(max(p) filter (base = {b}), 6) + 0.0 {x}" for b, x in enumerate("acgt")) + " from n group by label, pos")
def meme_rows(spark, d):
    counts = V.mat_long(spark, d).groupBy("label", "pos").pivot("base", [0, 1, 2, 3]).agg(F.sum("hit"))
    row = T.row_share(F.array(*[F.col(str(b)).cast("double") for b in range(4)]))
    return counts.select("label", "pos", row.alias("row")).select("label", "pos", *[r6(F.col("row")[b]).alias(x) for b, x in enumerate("acgt")])


@query(f"with {V.MAT}, c as (select label, pos, base, sum(h * hit) / cast(count(*) as double) / 1e6 m from mat group by all), s as (select label, pos, round(sum(abs(m)), 9) s from c group by all), t as (select *, max(s) over (partition by label) top from s) select label, min(pos) first_pos, max(pos) last_pos from t where s >= 0.3 * top group by label")
def trim_by_contribution(spark, d):
    m = V.mat_long(spark, d).groupBy("label", "pos", "base").agg((F.sum("contrib") / F.count(F.lit(1)) / 1e6).alias("m"))
    s = m.groupBy("label", "pos").agg(F.round(F.sum(F.abs("m")), 9).alias("s"))
    from pyspark.sql import Window

    return s.withColumn("top", F.max("s").over(Window.partitionBy("label"))).where("s >= 0.3 * top").groupBy("label").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


SUPPLIER = "mt as (select cast(s_nationkey as varchar) query, s_name target, abs(s_acctbal) / 100000 pval from supplier)"


def _matches(spark, d):
    return V.table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("query"), F.col("s_name").alias("target"), (F.abs("s_acctbal") / 100000).alias("pval"))


@query(f"with {SUPPLIER}, r as (select *, pval * count(*) over (partition by query) / row_number() over (partition by query order by pval, target) q from mt) select query, target, {R6.format('pval')} pval, {R6.format('least(1.0, min(q) over (partition by query order by pval, target rows between current row and unbounded following))')} qval from r")
def match_qvalues(spark, d):
    return M.with_qvalues(_matches(spark, d)).select("query", "target", r6("pval").alias("pval"), r6("qval").alias("qval"))


@query(f"with {SUPPLIER}, r as (select *, row_number() over (partition by query order by pval, target) k from mt) select query, max(case when k = 1 then target end) match0, {R6.format('max(case when k = 1 then pval end)')} pval0, max(case when k = 2 then target end) match1, {R6.format('max(case when k = 2 then pval end)')} pval1, max(case when k = 3 then target end) match2, {R6.format('max(case when k = 3 then pval end)')} pval2 from r group by query")
def motif_match_topn(spark, d):
    best = M.top_matches(_matches(spark, d), 3, by="pval")
    return best.select("query", *[c for k in range(3) for c in (F.col(f"match{k}"), r6(f"pval{k}").alias(f"pval{k}"))])


@query(f"with {SUPPLIER}, r as (select *, row_number() over (partition by query order by pval, target) k from mt) select query, string_agg(left(target, 10), ';' order by k) filter (k <= 3) as name from r group by query")
def descriptive_name(spark, d):
    return M.top_matches(_matches(spark, d), 3, by="pval").select("query", M.descriptive_name(3).alias("name"))


@query(f"with {V.WINDOWS}, r as (select example, pos, score, row_number() over (partition by example order by score, pos) - 1 r, count(*) over (partition by example) n from win), g as (select distinct example, cast(floor((10 + k * 10) / 100.0::double * (n - 1) + 0.5) as bigint) r from r, range(0, 10) t(k)) select example, pos, cast(score as double) score, cast(row_number() over (partition by example order by r desc) as integer) place from r join g using (example, r)")
def quantile_examples(spark, d):
    rows = G.window_sums(V.signal(spark, d), 5).withColumn("score", F.col("score").cast("double"))
    return report.quantile_examples(rows, 10, by=("example",), value="score")


@query()
def fdr_threshold(spark, d):
    """Both signs' thresholds at a false discovery rate of 0.2 against the fixed null."""
    scores = discovery.kept(G.window_sums(V.signal(spark, d), 5).select(F.col("score").cast("double")), "scores")
    mu = G.two_level_mode(scores)
    rates = {r.side: r for r in G.laplace_rates(scores, mu).collect()}
    share = rates["positive"].n / (rates["positive"].n + rates["negative"].n)
    null = G.laplace_null(spark, mu, rates["positive"].rate, rates["negative"].rate, share)
    out = []
    for name, keep, up in (("positive", F.col("score") >= 0, True), ("negative", F.col("score") < 0, False)):
        fit = G.isotonic_precision(scores.where(keep), null.where(keep).select("score"), increasing=up)
        out.append((name, G.fdr_threshold(fit, 0.2, increasing=up)))
    return spark.createDataFrame(out, "side string, threshold double")


def event_tracks(spark, d):
    """Carrier of whole tracks: a user's events as letters (type) with the value as importance of that letter."""
    letter = F.ascii(F.substring("event_type", 1, 1)) % 4
    value = F.col("value") / 100
    hyp = F.transform(F.array(*map(F.lit, range(4))), lambda b: F.when(b == letter, F.when(F.col("event_type") == "error", -value).otherwise(value)).otherwise(-value / 4))
    rows = V.table(spark, d, "events").groupBy(F.col("user_id").alias("example_idx")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", letter.cast("int").alias("l"), hyp.alias("h")))).alias("t"))
    return rows.select("example_idx", F.transform("t", lambda x: x["l"]).alias("letters"), F.transform("t", lambda x: x["h"]).alias("hyp"))


SMALL = discovery.Options(window=5, flank=2, trim=6, initial_flank=2)  # what short tracks need; the rest is the library's


@query()
def seqlet_extraction(spark, d):
    tracks = discovery.kept(event_tracks(spark, d), "tracks")
    return discovery.extract(tracks, SMALL)


@query()
def pattern_discovery(spark, d):
    tracks = discovery.kept(event_tracks(spark, d), "tracks")
    return discovery.discover(tracks, SMALL)


@query()
def motif_database_match(spark, d):
    """Mean base shares of each label as queries and as the database."""
    rows = meme_rows(spark, d)
    pwm = rows.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", F.array("a", "c", "g", "t").alias("r")))).alias("p"))
    motifs = discovery.kept(pwm.select(F.col("label").cast("string").alias("name"), F.transform("p", lambda x: x["r"]).alias("pwm")), "motifs")
    queries = {r.name: np.array(r.pwm) for r in motifs.collect()}  # a row per pattern
    return M.match_motifs(queries, motifs)


@query(f"with {V.SEQLETS} select suppkey, example_idx, start_pos, end_pos from seqlets where start_pos >= 0 and end_pos <= 60")
def seqlet_bounds(spark, d):
    rows = V.seqlets(spark, d).select("suppkey", "example_idx", "start_pos", "end_pos", "is_revcomp")
    return S.expand(rows, F.lit(0), F.lit(0), F.lit(60)).drop("is_revcomp")
