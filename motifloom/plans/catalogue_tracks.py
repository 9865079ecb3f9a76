"""Queries on matrices, tracks and seqlets, each with its SQL twin."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import tracks as T
from ..operators import patterns as P
from ..operators import seqlets as S
from ..operators import isotonic
from ..operators import signal as G
from . import carriers as V

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(x):
    return F.round(x, 6) + F.lit(0.0)


R6 = "round({}, 6) + 0.0"


@query(f"with {V.MAT} select vec_id, pos, base, h * hit contrib from mat")
def track_contrib(spark, d):
    rows = V.mat(spark, d).select("vec_id", F.posexplode(T.contributions(F.col("letters"), F.transform("hyp", lambda r: F.transform(r, lambda x: x.cast("double"))))).alias("pos", "row"))
    return rows.select("vec_id", "pos", F.posexplode("row").alias("base", "contrib")).withColumn("contrib", F.col("contrib").cast("bigint"))


@query(f"with {V.MAT} select vec_id, pos, cast(sum(h * hit) as bigint) attr from mat group by all")
def track_attr_sum(spark, d):
    return V.mat(spark, d).select("vec_id", F.posexplode(T.attribution(F.col("contrib"))).alias("pos", "attr")).withColumn("attr", F.col("attr").cast("bigint"))


@query(f"with {V.MAT} select vec_id, string_agg(substr('ACGT', base + 1, 1), '' order by pos) letters from mat where hit = 1 group by vec_id")
def consensus_letters(spark, d):
    return V.mat(spark, d).select("vec_id", T.letters_text(F.col("letters")).alias("letters"))


@query(f"with {V.MAT} select vec_id, string_agg(substr('ACGT', 4 - base, 1), '' order by pos desc) filter (hit = 1) letters, string_agg(cast(h as varchar), ',' order by pos desc, base desc) hyp from mat group by vec_id")
def revcomp(spark, d):
    text = F.array_join(F.transform(F.flatten(T.revcomp_matrix(F.col("hyp"))), lambda x: x.cast("string")), ",")
    return V.mat(spark, d).select("vec_id", T.letters_text(T.revcomp_letters(F.col("letters"))).alias("letters"), text.alias("hyp"))


@query(f"with {V.MAT} select vec_id, string_agg(cast(h as varchar), ',' order by pos, base) hyp from mat where pos between 3 and 12 group by vec_id")
def centre_crop(spark, d):
    return V.mat(spark, d).select("vec_id", F.array_join(F.transform(F.flatten(T.centre_crop(F.col("hyp"), 10)), lambda x: x.cast("string")), ",").alias("hyp"))


@query(f"with {V.MAT} select label, pos, base, count(*) n, cast(sum(hit) as bigint) total, sum(hit) / cast(count(*) as double) freq from mat group by all")
def pattern_ppm(spark, d):
    return P.position_means(V.mat_long(spark, d), "label", "pos", "base", value="hit").withColumnRenamed("mean", "freq")


@query(f"with {V.MAT} select label, pos, base, count(*) n, cast(sum(h * hit) as bigint) total, {R6.format('sum(h * hit) / cast(count(*) as double)')} mean_contrib from mat group by all")
def pattern_cwm(spark, d):
    found = P.position_means(V.mat_long(spark, d), "label", "pos", "base", value="contrib")
    return found.select("label", "pos", "base", "n", "total", r6("mean").alias("mean_contrib"))


@query(f"with {V.MAT} select base, cast(sum(hit) as bigint) hits, sum(hit) / cast(sum(sum(hit)) over () as double) share from mat group by base")
def background_freq(spark, d):
    return P.background(V.mat_long(spark, d))


@query(f"with {V.MAT} select label, pos, count(*) n from mat where hit = 1 group by all")
def position_support(spark, d):
    return V.mat_long(spark, d).where("hit = 1").groupBy("label", "pos").agg(F.count(F.lit(1)).alias("n"))


IC = f"""{V.MAT}, bg as (select base, sum(hit) / cast(sum(sum(hit)) over () as double) q from mat group by base),
ppm as (select label, pos, base, sum(hit) / cast(count(*) as double) p, count(*) n from mat group by all),
ic as (select label, pos, sum(p * log2((p + 0.001) / 1.004) - q * log2(q)) ic from ppm join bg using (base) group by label, pos)"""


def _ic(spark, d):
    long = V.mat_long(spark, d)
    ppm = P.position_means(long, "label", "pos", "base", value="hit").join(F.broadcast(P.background(long).select("base", F.col("share").alias("q"))), "base")  # four rows
    return P.information(ppm, F.col("q"), "label", "pos")


@query(f"with {IC} select label, pos, {R6.format('ic')} ic from ic")
def position_ic(spark, d):
    return _ic(spark, d).select("label", "pos", r6("ic").alias("ic"))


BEST = f"""{IC}, s as (select label, pos, round(sum(ic) over w, 9) s, count(*) over w n from ic window w as (partition by label order by pos rows between current row and 5 following)),
best as (select label, arg_max(pos, (s, -pos)) start_pos, max(s) ic from s where n = 6 group by label)"""


@query(f"with {BEST} select label, start_pos, {R6.format('ic')} ic from best")
def best_ic_window(spark, d):
    return P.best_window(_ic(spark, d), 6, "label").select("label", "start_pos", r6("ic").alias("ic"))


@query(f"with {BEST}, n as (select label, count(distinct vec_id) n from mat group by label) select label, n, {R6.format('ic')} ic from best join n using (label) where n >= 30 and ic >= 0.2")
def pattern_filter(spark, d):
    sizes = V.mat(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return P.best_window(_ic(spark, d), 6, "label").join(sizes, "label").where("n >= 30 and ic >= 0.2").select("label", "n", r6("ic").alias("ic"))


@query(f"with {V.MAT} select label, cast(sum(h * hit) as bigint) total, cast(sign(sum(h * hit)) as integer) sign from mat group by label")
def pattern_sign(spark, d):
    return V.mat_long(spark, d).groupBy("label").agg(F.sum("contrib").alias("total")).withColumn("sign", F.signum("total").cast("int"))


@query(f"with {V.MAT} select vec_id, label, cast(-sum(abs(h * hit)) as bigint) strength, row_number() over (partition by label order by sum(abs(h * hit)) desc, vec_id) nth from mat group by vec_id, label")
def seqlet_strength(spark, d):
    strength = (-T.total(F.flatten("contrib"), F.abs)).cast("bigint")
    return V.mat(spark, d).select("vec_id", "label", strength.alias("strength")).withColumn("nth", F.row_number().over(Window.partitionBy("label").orderBy("strength", "vec_id")).cast("bigint"))


def _flat(spark, d):
    return V.mat(spark, d).select("vec_id", "label", F.transform(F.flatten("hyp"), lambda x: x.cast("double")).alias("x"))


@query(f"with {V.MAT} select vec_id, pos * 4 + base idx, {R6.format('h / cast(sum(abs(h)) over (partition by vec_id) as double)')} v from mat")
def l1_normalise(spark, d):
    return _flat(spark, d).select("vec_id", F.posexplode(T.l1_normalise(F.col("x"))).alias("idx", "v")).withColumn("v", r6("v"))


@query(f"with {V.MAT}, c as (select vec_id, pos * 4 + base idx, h - sum(h) over w / 64.0::double x from mat window w as (partition by vec_id)) select vec_id, idx, {R6.format('x / (sqrt(sum(x * x) over (partition by vec_id)) + 1e-7)')} v from c")
def magnitude(spark, d):
    return _flat(spark, d).select("vec_id", F.posexplode(T.magnitude(F.col("x"))).alias("idx", "v")).withColumn("v", r6("v"))


@query(f"with {V.MAT} select vec_id, pos, base, {R6.format('exp(h / 1e6::double - max(h / 1e6::double) over w) / sum(exp(h / 1e6::double)) over w * exp(max(h / 1e6::double) over w)')} p from mat window w as (partition by vec_id, pos)")
def softmax(spark, d):
    rows = V.mat(spark, d).select("vec_id", F.posexplode("hyp").alias("pos", "row"))
    return rows.select("vec_id", "pos", F.posexplode(T.softmax(F.transform("row", lambda x: x / F.lit(1e6)))).alias("base", "p")).withColumn("p", r6("p"))


@query(f"with {V.MAT} select vec_id, pos, base, {R6.format('case when sum(abs(h)) over w = 0 then 0 else abs(h) / cast(sum(abs(h)) over w as double) end')} p from mat window w as (partition by vec_id, pos)")
def pfm(spark, d):
    rows = V.mat(spark, d).select("vec_id", F.posexplode("hyp").alias("pos", "row"))
    return rows.select("vec_id", "pos", F.posexplode(T.row_share(F.transform("row", lambda x: F.abs(x).cast("double")))).alias("base", "p")).withColumn("p", r6("p"))


@query(f"with {V.WINDOWS} select example, pos, score from win")
def window_sum(spark, d):
    return G.window_sums(V.signal(spark, d), 5).withColumn("score", F.col("score").cast("decimal(28,2)"))


@query(f"with {V.WINDOWS} select round(quantile_cont(abs(cast(score as double)), 0.8), 6) positive, -round(quantile_cont(abs(cast(score as double)), 0.8), 6) negative from win")
def threshold_percentile(spark, d):
    return G.percentile_thresholds(G.window_sums(V.signal(spark, d), 5), 0.2).select(r6("positive").alias("positive"), r6("negative").alias("negative"))


@query(f"with {V.WINDOWS} select count(*) filter (score >= 400 or score <= -100) passing, count(*) n, {R6.format('avg(case when score >= 400 or score <= -100 then 1 else 0 end)')} share from win")
def passing_fraction(spark, d):
    return G.passing_share(G.window_sums(V.signal(spark, d), 5), 400, -100).withColumn("share", r6("share"))


@query(f"""with {V.WINDOWS}, e as (select min(cast(score as double)) least, max(cast(score as double)) most from win),
b as (select least(floor((cast(score as double) - least) / ((most - least) / 1000)), 999) bin, count(*) n from win, e group by 1),
t as (select bin, n from b order by n desc, bin limit 1)
select {R6.format('least + bin * ((most - least) / 1000)')} lo, {R6.format('least + (bin + 1) * ((most - least) / 1000)')} hi, n, {R6.format('(least + bin * ((most - least) / 1000) + least + (bin + 1) * ((most - least) / 1000)) / 2')} centre from t, e""")
def mode_bin(spark, d):
    return G.mode_bin(G.window_sums(V.signal(spark, d), 5)).select(r6("lo").alias("lo"), r6("hi").alias("hi"), "n", r6("centre").alias("centre"))


def _laplace_sql(side: str, keep: str, dist: str) -> str:
    rates = ", ".join(f"-ln(1 - {0.05 * k:.2f}) / nullif(quantile_cont({dist}, {0.05 * k:.2f}), 0)" for k in range(1, 20))
    return f"select '{side}' side, {R6.format(f'greatest({rates})')} rate, count(*) n from (select cast(score as double) v from win) where {keep}"


@query(f"with {V.WINDOWS} {_laplace_sql('negative', 'v <= 200', '200 - v')} union all {_laplace_sql('positive', 'v >= 200', 'v - 200')}")
def laplace_rate(spark, d):
    return G.laplace_rates(G.window_sums(V.signal(spark, d), 5), 200.0).withColumn("rate", r6("rate"))


@query(f"""with {V.WINDOWS}, u as (select score, ((row_number() over (order by example, pos)) * 6185 % 10007 + 0.5::double) / 10007 side, ((row_number() over (order by example, pos)) * 7919 % 10009 + 0.5::double) / 10009 u, example, pos from win)
select example, pos, {R6.format("case when side < 0.6 then 200 - ln(1 - u) / 0.01 else 200 + ln(1 - u) / 0.02 end")} score from u""")
def null_sample(spark, d):
    rows = S.pair_ordinals(G.window_sums(V.signal(spark, d), 5), "example", "pos", "i")
    at = F.col("i") + 1
    side, u = (at * 6185 % 10007 + 0.5) / 10007, (at * 7919 % 10009 + 0.5) / 10009
    return rows.select("example", "pos", r6(G.null_value(side, u, 200.0, 0.01, 0.02, 0.6)).alias("score"))


BINNED = f"""{V.WINDOWS}, b as (select cast(floor(score / 20) as integer) bin, avg(case when pos % 3 = 0 then 1.0::double else 0.0 end) y, count(*) w from win group by 1),
r as (select a.bin lo, c.bin hi, sum(x.y * x.w) / sum(x.w) m from b a join b c on a.bin <= c.bin join b x on x.bin between a.bin and c.bin group by all)"""


def _binned(spark, d):
    rows = G.window_sums(V.signal(spark, d), 5)
    return rows.groupBy(F.floor(F.col("score") / 20).cast("int").alias("bin")).agg(F.avg((F.col("pos") % 3 == 0).cast("double")).alias("label"), F.count(F.lit(1)).cast("double").alias("weight"))


@query(f"""with {BINNED} select b.bin, {R6.format('max(n.m)')} fit from b join (select lo, bin, min(m) m from (select r.lo, r.hi, r.m, b.bin from r join b on r.lo <= b.bin and r.hi >= b.bin) group by lo, bin) n using (bin) group by b.bin""")
def isotonic_fit(spark, d):
    fits = isotonic.isotonic_fit(_binned(spark, d).withColumnRenamed("bin", "score"))
    return fits.select(F.col("score").cast("int").alias("bin"), r6("fit").alias("fit"))


@query(f"with {V.WINDOWS} select count(*) filter (abs(score) < 250) / cast(count(*) as double) rank from win")
def ecdf_rank(spark, d):
    scores = G.window_sums(V.signal(spark, d), 5)
    return scores.agg((F.count_if(F.abs("score") < 250) / F.count(F.lit(1))).alias("rank"))


@query(f"with {V.WINDOWS}, r as (select abs(score) s, row_number() over (order by abs(score)) - 1 i, count(*) over () n from win) select cast(s as double) v from r where i = cast(floor(0.8 * n) as bigint)")
def ecdf_value(spark, d):
    scores = G.window_sums(V.signal(spark, d), 5)
    return spark.createDataFrame([(G.ecdf_value(scores, 0.8),)], "v double")


@query(f"""with recursive {V.WINDOWS}, c as (select example, pos, abs(score) s, count(*) over (partition by example) d, score from win),
cand as (select example, pos, s, d, row_number() over (partition by example order by s desc, pos) k from c where (score >= 300 or score <= -100) and pos >= 2 and pos < d - 2),
walk as (select example, 0::bigint k, []::integer[] taken from (select distinct example from cand)
  union all select w.example, w.k + 1, case when len(list_filter(w.taken, lambda t: abs(t - c.pos) <= 4)) = 0 then list_append(w.taken, c.pos) else w.taken end
  from walk w join cand c on c.example = w.example and c.k = w.k + 1),
fin as (select example, arg_max(taken, k) taken from walk group by example)
select example, cast(i - 1 as integer) pick, taken[i] pos, taken[i] - 2 start_pos, taken[i] + 7 end_pos, cast(s as double) score
from (select example, taken, unnest(range(1, len(taken) + 1)) i from fin) f join c using (example) where c.pos = f.taken[f.i]""")
def seqlet_pick(spark, d):
    return S.pick_long(G.window_sums(V.signal(spark, d), 5), 5, 2, 4, 300.0, -100.0).withColumn("score", F.round("score", 2))


@query(f"with {V.WINDOWS}, m as (select example, pos, score, case when score > 250 then 'pos' when score < -50 then 'neg' end metacluster from win) select example, pos, cast(score as decimal(28,2)) score, metacluster from m where metacluster is not null")
def seqlet_sign_split(spark, d):
    rows = G.window_sums(V.signal(spark, d), 5)
    shifted = S.sign_split(rows.withColumn("core", F.col("score") - 100), F.col("core"), 150.0).drop("core")
    return shifted.withColumn("score", F.col("score").cast("decimal(28,2)"))


@query(f"with {V.WINDOWS}, m as (select example, pos, case when score > 250 then 'pos' when score < -50 then 'neg' end metacluster from win), n as (select *, row_number() over (partition by metacluster order by example, pos) - 1 ord from m where metacluster is not null) select example, pos, metacluster, cast(ord as bigint) ord from n where ord < 100")
def seqlet_cap(spark, d):
    rows = G.window_sums(V.signal(spark, d), 5)
    shifted = S.sign_split(rows.withColumn("core", F.col("score") - 100), F.col("core"), 150.0).select("example", "pos", "metacluster")
    return S.cap(shifted, 100, "example", "pos").withColumn("ord", F.col("ord").cast("bigint"))


@query(f"""with {V.WINDOWS}, e as (select min(cast(score as double)) lo, max(cast(score as double)) hi, count(*) n from win),
b as (select cast(least(floor((cast(score as double) - lo) / ((hi - lo) / 30)), 29) as integer) bin, count(*) k from win, e group by 1)
select bin, k, {R6.format('lo + bin * (hi - lo) / 30')} left_edge, {R6.format('k / (n * ((hi - lo) / 30))')} density from b, e""")
def plot_histogram(spark, d):
    return histogram(G.window_sums(V.signal(spark, d), 5), 30).select("bin", "k", r6("left_edge").alias("left_edge"), r6("density").alias("density"))


def histogram(values, bins: int, value: str = "score"):
    """Counts and densities of equal bins."""
    v = F.col(value).cast("double")
    ends = values.agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(F.lit(1)).alias("n"))  # one row
    width = (F.col("hi") - F.col("lo")) / bins
    rows = values.crossJoin(F.broadcast(ends)).groupBy(F.least(F.floor((v - F.col("lo")) / width), F.lit(bins - 1)).cast("int").alias("bin"), "lo", "hi", "n").agg(F.count(F.lit(1)).alias("k"))
    return rows.select("bin", "k", (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("left_edge"), (F.col("k") / (F.col("n") * width)).alias("density"))


PIECE = 10_000  # characters ranked together before a text's pieces meet


@query(
    """with c as (select doc_id, regexp_extract_all(text, '(?s).') cs from documents where text <> ''),
    lets as (select doc_id, unnest(range(0, len(cs))) pos, unnest(cs) c from c),
    r as (select doc_id, pos, row_number() over (partition by doc_id order by ascii(c) % 7 - 3 desc, pos) k from lets)
    select doc_id, string_agg(cast(pos as varchar), ',' order by pos) positions from r where k <= 20 group by doc_id"""
)
def top_positions(spark, d):
    """Every text's 20 positions of highest importance, ties to the earlier: ranked by pieces, then over the pieces."""
    docs = V.table(spark, d, "documents").where("text <> ''").select("doc_id", "text")

    def ranked(batches):
        for batch in batches:
            found = [best_positions(text) for text in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *(len(places) for _, places in found)])
            n, pos = (np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64) for c in (0, 1))
            best = pa.StructArray.from_arrays([pa.array(n), pa.array(pos)], names=["n", "pos"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), best)], names=["doc_id", "best"])

    best = docs.mapInArrow(ranked, "doc_id bigint, best array<struct<n:bigint,pos:bigint>>")
    rows = best.groupBy("doc_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, 20).alias("best"))  # texts of one id meet
    places = F.array_sort(F.transform("best", lambda x: x["pos"]))
    return rows.select("doc_id", F.array_join(F.transform(places, lambda p: p.cast("string")), ",").alias("positions"))


def best_positions(text: str, k: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """(3 - code point % 7, place) of a text's k least, ties to the earlier."""
    ranks, places = [], []
    for first in range(0, len(text), PIECE):
        rank = 3 - (np.frombuffer(text[first : first + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32) % 7).astype(np.int8)
        at = np.argsort(rank, kind="stable")[:k]
        ranks.append(rank[at].astype(np.int64))
        places.append(at + first)
    rank, place = np.concatenate(ranks), np.concatenate(places)
    at = np.lexsort((place, rank))[:k]
    return rank[at], place[at]


@query("with c as (select lang, l pos, (select count(*) from documents e where e.lang = x.lang and e.n_chars > l * 100) n from (select lang, unnest(range(0, cast(max(n_chars) // 100 + 1 as bigint))) l from documents group by lang) x), t as (select *, least(30.0, 0.2 * max(n) over (partition by lang)) need from c) select lang pattern, cast(min(pos) as bigint) first_pos, cast(max(pos) as bigint) last_pos from t where n >= need group by lang")
def trim_to_support(spark, d):
    docs = V.table(spark, d, "documents").select(F.col("lang").alias("pattern"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("(n_chars - 1) div 100"))).alias("pos"))
    return P.support_range(docs.groupBy("pattern", "pos").agg(F.count(F.lit(1)).alias("n")), 0.2, 30)


@query(f"with {V.SEQLETS} select example_idx, start_pos + case when is_revcomp then -5 else 5 end start_pos, end_pos + case when is_revcomp then -5 else 5 end end_pos, is_revcomp from seqlets where start_pos + case when is_revcomp then -5 else 5 end >= 0 and end_pos + case when is_revcomp then -5 else 5 end < 80")
def shift_bounds(spark, d):
    return S.shift(V.seqlets(spark, d).select("example_idx", "start_pos", "end_pos", "is_revcomp"), F.lit(5), F.lit(80))


@query(f"with {V.SEQLETS}, g as (select example_idx, start_pos - case when is_revcomp then 7 else 3 end start_pos, end_pos + case when is_revcomp then 3 else 7 end end_pos, is_revcomp from seqlets) select distinct * from g where start_pos >= 0 and end_pos <= 90")
def expand_fill(spark, d):
    grown = S.expand(V.seqlets(spark, d).select("example_idx", "start_pos", "end_pos", "is_revcomp"), F.lit(3), F.lit(7), F.lit(90))
    return grown.distinct()


@query(f"with {V.SEQLETS}, s as (select example_idx, is_revcomp, case when is_revcomp then end_pos - 2 - 4 else start_pos + 2 end start_pos from seqlets) select example_idx, is_revcomp, start_pos, start_pos + 4 end_pos from s")
def trim(spark, d):
    return S.trim(V.seqlets(spark, d).select("example_idx", "start_pos", "end_pos", "is_revcomp"), F.lit(2), F.lit(4))


@query(f"with {V.SEQLETS} select example_idx, start_pos, end_pos, min(suppkey) first_suppkey, arg_max(partkey, (suppkey, partkey)) partkey from seqlets group by example_idx, start_pos, end_pos")
def unique_last_wins(spark, d):
    return S.distinct_last(V.seqlets(spark, d), ("example_idx", "start_pos", "end_pos"), ("suppkey",), ("partkey",))


BED = f"""{V.SEQLETS}, {V.PEAKS}, p as (select chrom, start_pos ps, end_pos pe, score, row_number() over (order by ord) - 1 example_idx from peaks),
j as (select chrom, (ps + pe) // 2 - 200 + s.start_pos + 1 cs, (ps + pe) // 2 - 200 + s.end_pos ce, score, case when is_revcomp then '-' else '+' end strand, suppkey, s.start_pos, s.end_pos, example_idx from seqlets s join p using (example_idx))"""


@query(f"with {BED} select concat_ws(chr(9), chrom, cs, ce, 'pos_patterns.' || (suppkey % 5), score, strand) line, count(*) n from j group by 1")
def seqlet_bed(spark, d):
    rows = S.absolute(S.with_peaks(V.seqlets(spark, d), V.peaks(spark, d)), 400)
    line = F.concat_ws("\t", "chrom", F.col("chrom_start").cast("string"), F.col("chrom_end").cast("string"), F.concat(F.lit("pos_patterns."), (F.col("suppkey") % 5).cast("string")), "score", "strand")
    return rows.select(line.alias("line")).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {BED} select chrom || ':' || cs || '-' || ce || ' dir=' || strand || ' pos_patterns.' || (suppkey % 5) header, repeat('ACGT', cast((end_pos - start_pos) // 4 + 1 as integer))[1:(end_pos - start_pos)] letters, count(*) n from j group by all")
def seqlet_fasta(spark, d):
    rows = S.absolute(S.with_peaks(V.seqlets(spark, d), V.peaks(spark, d)), 400)
    header = F.concat("chrom", F.lit(":"), F.col("chrom_start").cast("string"), F.lit("-"), F.col("chrom_end").cast("string"), F.lit(" dir="), "strand", F.lit(" pos_patterns."), (F.col("suppkey") % 5).cast("string"))
    letters = T.letters_text(F.transform(F.sequence(F.lit(0), F.col("end_pos") - F.col("start_pos") - 1), lambda i: (i % 4).cast("int")))
    letters = F.when(F.col("end_pos") > F.col("start_pos"), letters).otherwise(F.lit(""))
    return rows.select(header.alias("header"), letters.alias("letters")).groupBy("header", "letters").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {V.PEAKS} select chrom, start_pos, end_pos, row_number() over (order by ord) - 1 example_idx from peaks where chrom in ('F', 'P')")
def chrom_filter(spark, d):
    kept = V.peaks(spark, d).where(F.col("chrom").isin("F", "P"))
    return S.dense_ordinals(kept, "ord", "example_idx").select("chrom", "start_pos", "end_pos", "example_idx")


@query(f"with {V.SEQLETS} select example_idx, 'example:' || example_idx || ',start:' || start_pos || ',end:' || end_pos || ',rc:' || case when is_revcomp then 'True' else 'False' end line from seqlets")
def legacy_seqlet_format(spark, d):
    from ..sources.legacy import format_seqlet

    return V.seqlets(spark, d).select("example_idx", format_seqlet().alias("line"))


@query(f"with {V.SEQLETS} select example_idx, start_pos, end_pos, is_revcomp from seqlets")
def legacy_seqlet_parse(spark, d):
    from ..sources.legacy import format_seqlet, parse_seqlet

    return parse_seqlet(V.seqlets(spark, d).select(format_seqlet().alias("line")), "line")


@query(f"with {V.SEQLETS} select suppkey, count(*) n, {R6.format('avg(cast(end_pos - start_pos as double))')} avg_width, {R6.format('stddev_pop(cast(price as double))')} std_price, avg(case when is_revcomp then 1.0::double else 0.0 end) rc_share from seqlets group by suppkey")
def pattern_stats(spark, d):
    s = V.seqlets(spark, d)
    return s.groupBy("suppkey").agg(F.count(F.lit(1)).alias("n"), r6(F.avg((F.col("end_pos") - F.col("start_pos")).cast("double"))).alias("avg_width"), r6(F.stddev_pop("price")).alias("std_price"), F.avg(F.col("is_revcomp").cast("double")).alias("rc_share"))


@query(f"with {V.SEQLETS} select min(start_pos) least, max(end_pos) most, (min(start_pos) + max(end_pos)) // 2 middle from seqlets")
def global_extent(spark, d):
    return V.seqlets(spark, d).agg(F.min("start_pos").alias("least"), F.max("end_pos").alias("most")).withColumn("middle", F.expr("cast((least + most) div 2 as int)"))


@query(f"with {V.SEQLETS}, e as (select (min(start_pos) + max(end_pos)) / 2.0::double c from seqlets), x as (select suppkey, abs((start_pos + end_pos) / 2.0::double - c) dist from seqlets, e) select suppkey, {R6.format('quantile_cont(dist, 0.5)')} median_dist, {R6.format('stddev_pop(dist)')} std_dist from x group by suppkey")
def centre_distance(spark, d):
    s = V.seqlets(spark, d)
    ends = s.agg(((F.min("start_pos") + F.max("end_pos")) / 2).alias("c"))  # one row
    dist = F.abs((F.col("start_pos") + F.col("end_pos")) / 2 - F.col("c"))
    return s.crossJoin(F.broadcast(ends)).select("suppkey", dist.alias("dist")).groupBy("suppkey").agg(r6(F.percentile("dist", 0.5)).alias("median_dist"), r6(F.stddev_pop("dist")).alias("std_dist"))


@query(f"with {V.SEQLETS}, r as (select case when example_idx % 2 = 0 then 0 else 1 end run, example_idx from seqlets group by all), n as (select run, example_idx, dense_rank() over (partition by run order by example_idx) - 1 k from r), o as (select run, coalesce(sum(count(*)) over (order by run rows between unbounded preceding and 1 preceding), 0) off from r group by run) select n.run, n.example_idx, cast(k + off as bigint) new_idx from n join o using (run)")
def run_merge_index(spark, d):
    s = V.seqlets(spark, d).select((F.col("example_idx") % 2).cast("int").alias("run"), "example_idx").distinct()
    return S.dense_ordinals(s.withColumn("_o", F.col("run") * 10**12 + F.col("example_idx")), "_o", "new_idx").drop("_o")
