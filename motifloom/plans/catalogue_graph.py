"""Queries on similarities and graphs, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import tracks as T
from ..operators import community as C
from ..operators import density as D
from ..operators import gkmers as K
from ..operators import similarity as S
from ..sources.shared import kept
from . import carriers as V
from .catalogue_tracks import R6, r6

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _vectors(spark, d):
    return V.mat(spark, d).select(F.col("vec_id").alias("id"), F.transform(F.flatten("hyp"), lambda x: x.cast("double")).alias("v"))  # whole numbers: sums are exact


KNN = f"""{V.MAT}, pr as (select a.vec_id i, b.vec_id j, round(cast(sum(case when sign(a.h) * sign(b.h) >= 0 then 1 else -1 end * least(abs(a.h), abs(b.h))) as double) / cast(sum(greatest(abs(a.h), abs(b.h))) as double), 12) sim
  from mat a join mat b on a.pos = b.pos and a.base = b.base group by a.vec_id, b.vec_id),
rk as (select *, row_number() over (partition by i order by sim desc, j) rank from pr), knn as (select i, j, sim, rank from rk where rank <= 6)"""


def _knn(spark, d, k=6):
    """Written, since what follows reads it several times."""
    return kept(S.jaccard_knn(_vectors(spark, d), k), "knn")


@query(f"with {KNN} select i, j, {R6.format('sim')} sim, cast(rank as integer) rank from knn")
def jaccard_knn(spark, d):
    return _knn(spark, d).select("i", "j", r6("sim").alias("sim"), "rank")


def _label_means(spark, d):
    """label -> mean hypothetical matrix, as 64 doubles."""
    rows = V.mat_long(spark, d).groupBy("label", "pos", "base").agg((F.sum("h") / F.count(F.lit(1)) / 1e6).alias("m"))
    return rows.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "base", "m"))), lambda x: x["m"]).alias("m"))


def _label_pairs(spark, d):
    """Ordered pairs of different labels: as many as there are patterns, squared."""
    m = _label_means(spark, d)
    other = m.select(F.col("label").alias("j"), F.col("m").alias("y"))
    return m.select(F.col("label").alias("i"), F.col("m").alias("x")).crossJoin(other).where("i <> j")


OFFSETS = f"""{V.MAT}, m as (select label, pos, base, sum(h) / cast(count(*) as double) / 1e6 m from mat group by all),
rv as (select label, 15 - pos pos, 3 - base base, m from m), x as (select 0 rc, * from m union all select 1 rc, * from rv),
g as (select a.label i, b.label j, o, rc from (select distinct label from m) a, (select distinct label from m) b, range(-5, 6) r(o), (values (0), (1)) v(rc) where a.label <> b.label),
full_ as (select g.i, g.j, o, g.rc, x.m xv, coalesce(y.m, 0) yv from g join x on x.label = g.i and x.rc = g.rc left join m y on y.label = g.j and y.base = x.base and y.pos = x.pos + o),
sc as (select i, j, o, rc, round(sum(sign(xv) * sign(yv) * least(abs(xv), abs(yv))) / sum(greatest(abs(xv), abs(yv))), 9) jac,
  round(sum(xv * yv) / nullif(sqrt(sum(xv * xv) * sum(yv * yv)), 0), 9) cos from full_ group by all)"""


def _best(x, y, score):
    rounded = lambda a, b: F.round(score(a, b), 9)
    return T.best_offset(T.at_offsets(x, y, 5, 4, rounded))


def _reverse(x):
    return F.reverse(x)  # positions and bases reversed together in a flat matrix


@query(f"with {OFFSETS} select i, j, arg_max(o, (jac, -o)) \"offset\", {R6.format('max(jac)')} score from sc where rc = 0 group by i, j")
def jaccard_offset(spark, d):
    best = _best(F.col("x"), F.col("y"), T.jaccard)
    return _label_pairs(spark, d).select("i", "j", best.alias("b")).select("i", "j", F.col("b.offset").cast("bigint").alias("offset"), r6("b.score").alias("score"))


@query(f"with {OFFSETS} select i, j, arg_max(o, (coalesce(cos, 0), -o)) \"offset\", {R6.format('max(coalesce(cos, 0))')} score from sc where rc = 0 group by i, j")
def offset_cosine(spark, d):
    best = _best(F.col("x"), F.col("y"), T.cosine)
    return _label_pairs(spark, d).select("i", "j", best.alias("b")).select("i", "j", F.col("b.offset").cast("bigint").alias("offset"), r6("b.score").alias("score"))


@query(f"with {OFFSETS}, b as (select i, j, rc, arg_max(o, (jac, -o)) o, max(jac) s from sc group by all) select f.i, f.j, r.s > f.s is_rc, case when r.s > f.s then r.o else f.o end \"offset\", {R6.format('greatest(r.s, f.s)')} score from b f join b r using (i, j) where f.rc = 0 and r.rc = 1")
def align_strand(spark, d):
    rows = _label_pairs(spark, d).select("i", "j", _best(F.col("x"), F.col("y"), T.jaccard).alias("f"), _best(_reverse(F.col("x")), F.col("y"), T.jaccard).alias("r"))
    rc = F.col("r.score") > F.col("f.score")
    pick = F.when(rc, F.col("r")).otherwise(F.col("f"))
    return rows.select("i", "j", rc.alias("is_rc"), pick["offset"].cast("bigint").alias("offset"), r6(pick["score"]).alias("score"))


GKMER = f"""{V.MAT}, imp as (select vec_id, pos, base, h from mat where hit = 1),
kept as (select * from (select *, row_number() over (partition by vec_id order by h desc, pos) r from imp) where r <= 8),
gk as (select a.vec_id, (a.base + 1) + (b.base + 1) * power(5, b.pos - a.pos) + (c.base + 1) * power(5, c.pos - a.pos) + (d.base + 1) * power(5, d.pos - a.pos) gkmer, a.h + b.h + c.h + d.h v,
  ((a.pos * 100 + d.pos) * 100 + b.pos) * 100 + c.pos nth from kept a join kept b on b.vec_id = a.vec_id and b.pos > a.pos join kept c on c.vec_id = a.vec_id and c.pos > b.pos join kept d on d.vec_id = a.vec_id and d.pos > c.pos where d.pos - a.pos < 15),
gt as (select vec_id, cast(gkmer as bigint) gkmer, cast(sum(v) as bigint) total, min(nth) nth from gk group by all having sum(v) <> 0)"""


def _gkmers(spark, d, forward=True, entries=1000):
    rows = V.mat(spark, d).select(F.col("vec_id").alias("id"), "letters", F.transform("contrib", lambda r: T.total(r)).alias("importance"))
    return K.seqlet_gkmers(rows, topn=8, min_k=4, max_k=4, max_entries=entries, forward=forward)


@query(f"with {GKMER} select vec_id, gkmer, total from gt")
def gkmer_extract(spark, d):
    return _gkmers(spark, d).select(F.col("id").alias("vec_id"), "gkmer", F.round(F.col("value") * 4).cast("bigint").alias("total"))


@query(f"with {GKMER} select vec_id, gkmer, total, cast(r as integer) rank from (select *, row_number() over (partition by vec_id order by abs(total) desc, nth) r from gt) where r <= 10")
def gkmer_topn(spark, d):
    return _gkmers(spark, d, entries=10).select(F.col("id").alias("vec_id"), "gkmer", F.round(F.col("value") * 4).cast("bigint").alias("total"), (F.col("nth") + 1).alias("rank"))


REVERSED = GKMER.replace("imp as (select vec_id, pos, base, h from mat where hit = 1)", "imp as (select vec_id, 15 - pos pos, 3 - base base, h from mat where hit = 1)")
for _name in ("imp", "kept", "gk", "gt"):
    REVERSED = REVERSED.replace(f"{_name} as (", f"r{_name} as (").replace(f"from {_name} ", f"from r{_name} ").replace(f"from {_name})", f"from r{_name})").replace(f"join {_name} ", f"join r{_name} ")
REVERSED = REVERSED[REVERSED.index("rimp as (") :]
COARSE = f"""{GKMER}, {REVERSED},
fw as (select vec_id, gkmer, total / sqrt(sum(cast(total as double) * total) over (partition by vec_id)) v from gt),
rw as (select vec_id, gkmer, total / sqrt(sum(cast(total as double) * total) over (partition by vec_id)) v from rgt),
s1 as (select a.vec_id i, b.vec_id j, sum(a.v * b.v) s from fw a join fw b using (gkmer) group by all), s2 as (select a.vec_id i, b.vec_id j, sum(a.v * b.v) s from fw a join rw b using (gkmer) group by all),
al as (select a.vec_id i, b.vec_id j, round(greatest(coalesce(s1.s, 0), coalesce(s2.s, 0)), 9) sim from embeddings a cross join embeddings b left join s1 on s1.i = a.vec_id and s1.j = b.vec_id left join s2 on s2.i = a.vec_id and s2.j = b.vec_id)"""


@query(f"with {COARSE} select i, j, round(sim, 5) + 0.0 sim from (select *, row_number() over (partition by i order by sim desc, j) r from al) where r <= 3 and sim > 0")
def coarse_knn(spark, d):
    ids = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    found = K.coarse_knn(_gkmers(spark, d), _gkmers(spark, d, forward=False), ids, 3)
    return found.where("sim > 1e-9").select("i", "j", (F.round("sim", 5) + F.lit(0.0)).alias("sim"))


@query(f"with {KNN}, x as (select i, sim x, (j * 7919) % 101 y from knn where abs(sim) > 0), r as (select i, rank() over (partition by i order by x) + (count(*) over (partition by i, x) - 1) / 2.0::double rx, rank() over (partition by i order by y) + (count(*) over (partition by i, y) - 1) / 2.0::double ry from x) select i, {R6.format('corr(rx, ry)')} rho from r group by i having corr(rx, ry) > 0.15")
def spearman_filter(spark, d):
    rows = _knn(spark, d).where(F.abs("sim") > 0).select("i", F.col("sim").alias("x"), (F.col("j") * 7919 % 101).alias("y"))
    return S.rank_correlation(rows).where(F.col("rho") > 0.15).select("i", r6("rho").alias("rho"))


EDGES = f"{KNN}, ed as (select i, j, greatest(ln(2 / greatest(sim, 1e-7) - 1), 0) d from knn)"


@query(f"with {EDGES} select i, j, {R6.format('d')} d from ed where d > 0")
def sim_to_distance(spark, d):
    return D.distances(_knn(spark, d)).select("i", "j", r6("d").alias("d"))


SYM = f"{EDGES}, sy as (select i, j, avg(d) d from (select i, j, d from ed where d > 0 union all select j, i, d from ed where d > 0) group by i, j)"


@query(f"with {SYM} select i, j, {R6.format('d')} d from sy")
def symmetrise(spark, d):
    return D.symmetrise(D.distances(_knn(spark, d)), "d").select("i", "j", r6("d").alias("d"))


WEIGHTS = f"""{SYM}, be as (select i, 1.0::double + (i % 3) / 2.0::double beta from sy group by i), e as (select sy.i, j, exp(-d / beta) e from sy join be using (i)),
z as (select i, 1 + sum(e) z from e group by i), sh as (select e.i, j, e / z p from e join z using (i)),
gw as (select a.i src, a.j dst, sqrt(a.p * b.p) weight from sh a join sh b on a.i = b.j and a.j = b.i union all select i, i, 1 / z from z)"""


def _weights(spark, d):
    edges = D.symmetrise(D.distances(_knn(spark, d)), "d")
    return D.density_weights(edges, edges.select("i").distinct().withColumn("beta", 1 + (F.col("i") % 3) / 2))


@query(f"with {WEIGHTS} select src, dst, {R6.format('weight')} weight from gw")
def density_weights(spark, d):
    return _weights(spark, d).select("src", "dst", r6("weight").alias("weight"))


#: `ds` (i, sorted distances) -> w: one row per i and step of the search for the precision
BISECTION = """w as (select i, ds, 0 k, 1.0::double b, null::double lo, null::double hi, false done from ds
 union all select i, ds, k + 1, case when done or abs(off) < 1e-5 then b when off > 0 then case when hi is null then b * 2 else (b + hi) / 2 end else case when lo is null then b / 2 else (b + lo) / 2 end end,
  case when done or abs(off) < 1e-5 then lo when off > 0 then b else lo end, case when done or abs(off) < 1e-5 then hi when off > 0 then hi else b end, done or abs(off) < 1e-5
 from (select *, ln(1 + list_sum(list_transform(ds, lambda x: exp(-x * b)))) + b * list_sum(list_transform(ds, lambda x: x * exp(-x * b))) / (1 + list_sum(list_transform(ds, lambda x: exp(-x * b)))) - ln(3) off from w where k < {steps}))"""


@query(f"""with recursive {SYM}, ds as (select i, list(d order by d) ds from sy group by i), {BISECTION.format(steps=60)}
select i, round(b, 4) + 0.0 beta from w where k = 60""")
def perplexity_beta(spark, d):
    edges = D.symmetrise(D.distances(_knn(spark, d)), "d")
    return D.precisions(edges, 3.0).select("i", (F.round("beta", 4) + F.lit(0.0)).alias("beta"))


@query(f"""with recursive {KNN.replace("rank <= 6", "rank <= 12")}, ed as (select i, j, greatest(ln(2 / greatest(sim, 1e-7) - 1), 0) d, row_number() over (partition by i order by sim desc, j) r from knn where i <> j),
ds as (select i, list(d order by d) ds from ed where r <= 10 group by i), {BISECTION.format(steps=100)},
x as (select ed.i, j, exp(-d * b) w from ed join w on w.i = ed.i and w.k = 100 where r <= 10), p as (select i, j, w / sum(w) over (partition by i) p from x),
both_ways as (select i, j, sum(p) p from (select i, j, p from p union all select j, i, p from p) group by i, j)
select i, j, round(p / (select sum(p) from both_ways), 9) + 0.0 p from both_ways""")
def tsne_probabilities(spark, d):
    """Nine digits: the largest probabilities are near one over ten times the number of rows."""
    return D.conditional_probabilities(_knn(spark, d, 12), 3.0).select("i", "j", (F.round("p", 9) + F.lit(0.0)).alias("p"))


@query(f"with {WEIGHTS}, l as (select vec_id, label from embeddings), x as (select a.label cs, b.label cd, weight from gw join l a on a.vec_id = src join l b on b.vec_id = dst), m as (select sum(weight) m from x), s as (select cs c, sum(case when cs = cd then weight else 0 end) ins, sum(weight) o from x group by cs), t as (select cd c, sum(weight) t from x group by cd) select {R6.format('sum(ins / m - power((o + t) / (2 * m), 2))')} q from s join t using (c), m")
def modularity(spark, d):
    labels = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("node"), F.col("label").alias("community"))
    return D.modularity(_weights(spark, d), labels).select(r6("q").alias("q"))


@query()
def community(spark, d):
    return C.communities(_weights(spark, d))


@query("select label, count(*) n, cast(row_number() over (order by count(*) desc, label) as integer) place from embeddings group by label")
def cluster_sizes(spark, d):
    sizes = V.table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return sizes.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "label")))  # a row per pattern


@query(f"with {KNN}, x as (select a.label, case when b.label = a.label then 1 else 0 end hit, sim from knn join embeddings a on a.vec_id = i join embeddings b on b.vec_id = j), r as (select label, hit, rank() over (partition by label order by sim) + (count(*) over (partition by label, sim) - 1) / 2.0::double r from x) select label, {R6.format('coalesce((sum(r) filter (hit = 1) - sum(hit) * (sum(hit) + 1) / 2.0::double) / nullif(sum(hit) * (count(*) - sum(hit)), 0), 0.5)')} auroc from r group by label")
def auroc_pairs(spark, d):
    labels = V.table(spark, d, "embeddings")
    rows = _knn(spark, d).join(labels.select(F.col("vec_id").alias("i"), F.col("label").alias("pattern")), "i").join(labels.select(F.col("vec_id").alias("j"), F.col("label").alias("other")), "j")
    rows = rows.select("pattern", (F.col("pattern") == F.col("other")).cast("int").alias("label"), F.col("sim").alias("score"))
    return S.auroc(rows, by=("pattern",)).select(F.col("pattern").alias("label"), r6("auroc").alias("auroc"))


@query(f"with {OFFSETS}, b as (select i, j, round(max(jac), 6) s from sc group by i, j), y as (select least(i, j) a, greatest(i, j) b, sum(s) sim_both from b group by 1, 2) select a, b, {R6.format('sim_both')} sim_both, cast(row_number() over (order by round(sim_both, 6) desc, a, b) as integer) place from y where sim_both >= 0.1")
def merge_pairs(spark, d):
    aligned = align_strand(spark, d)
    pairs = aligned.groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.sum("score").alias("sim_both")).where("sim_both >= 0.1")
    return pairs.select("a", "b", r6("sim_both").alias("sim_both")).withColumn("place", F.row_number().over(Window.orderBy(F.desc("sim_both"), "a", "b")))  # pairs of patterns
