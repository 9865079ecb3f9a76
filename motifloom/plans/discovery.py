"""Pattern discovery end to end: tracks -> seqlets -> similarity -> graph -> communities -> patterns.

Tables go from step to step as written tables in the shared folder. Scalars (thresholds, background, counts), and scores and
sizes of patterns, are all that reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tracks as T
from ..operators import building as B
from ..operators import community, density, gkmers, seqlets, signal, similarity
from ..sources.shared import kept

MEMBERS = "pattern int, subpattern int, ord int, example_idx bigint, start_pos int, end_pos int, is_revcomp boolean"


@dataclass(frozen=True)
class Options:
    """Parameters of a discovery; the defaults are those of the library call."""

    window: int = 21
    flank: int = 10
    target_fdr: float = 0.2
    least_passing: float = 0.03
    most_passing: float = 0.2
    weak_threshold: float = 0.8
    min_metacluster: int = 100
    max_seqlets: int = 20_000
    neighbours: int = 500
    min_overlap: float = 0.7
    correlation: float = 0.15
    perplexity: float = 10.0
    n_seeds: int = 50
    min_share: float = 0.2
    min_n: int = 30
    initial_flank: int = 10
    trim: int = 30
    final_flank: int = 0
    min_support: int = 20
    min_ic: float = 0.6
    ic_window: int = 6
    subcluster_perplexity: float = 50.0
    merge_sample: int = 1000
    rounds: int = 2


def extract(tracks: DataFrame, o: Options) -> DataFrame:
    """tracks (example_idx, letters, hyp) -> seqlets of both metaclusters (metacluster, ord, example_idx, start_pos, end_pos,
    is_revcomp), each capped."""
    spark = tracks.sparkSession
    attr = tracks.select(F.col("example_idx").alias("example"), T.attribution(T.contributions(F.col("letters"), F.col("hyp"))).alias("attr"))
    sums = kept(attr.select("example", "attr", F.transform(T.sliding_sums(F.col("attr"), o.window), lambda x: F.round(x, 9)).alias("sums")), "sums")
    scores = sums.select(F.explode("sums").alias("score"))
    mu = signal.two_level_mode(scores)
    rates = {r.side: r for r in signal.laplace_rates(scores, mu).collect()}
    if any(r.rate is None for r in rates.values()):
        positive = negative = None
    else:
        n = {k: r.n for k, r in rates.items()}
        null = signal.laplace_null(spark, mu, rates["positive"].rate, rates["negative"].rate, n["positive"] / (n["positive"] + n["negative"]))
        found = []
        for keep, up in ((F.col("score") >= 0, True), (F.col("score") < 0, False)):
            fit = signal.isotonic_precision(scores.where(keep), null.where(keep).select("score"), increasing=up)
            found.append(signal.fdr_threshold(fit, o.target_fdr, increasing=up))
        positive, negative = found
    positive, negative = signal.refined_thresholds(scores, positive, negative, o.least_passing, o.most_passing)
    suppress = int(0.5 * o.window) + o.flank
    masked = seqlets.mask_scores(F.col("sums"), positive, negative, o.flank)
    picks = sums.select("example", "attr", F.posexplode(T.pick_peaks(masked, o.flank, suppress)).alias("pick", "p"))
    ranks = [signal.ecdf_rank(scores, abs(t)) for t in (positive, negative) if np.isfinite(t)]
    weak = signal.ecdf_value(scores, max(0.0, min([o.weak_threshold, *(r - 0.0001 for r in ranks)])))
    at = F.col("p.pos")
    core = T.total(F.slice("attr", at + 1, o.window))
    rows = picks.select(F.col("example").alias("example_idx"), "pick", (at - o.flank).alias("start_pos"), (at + o.window + o.flank).alias("end_pos"), core.alias("core"), F.lit(False).alias("is_revcomp"))
    split = seqlets.cap(seqlets.sign_split(rows, F.col("core"), weak), o.max_seqlets, "example_idx", "pick")
    return kept(split.select("metacluster", "ord", "example_idx", "start_pos", "end_pos", "is_revcomp"), "seqlets")


def hydrate(rows: DataFrame, tracks: DataFrame) -> DataFrame:
    """Adds letters and the hypothetical matrix of each seqlet on its strand."""
    t = tracks.select("example_idx", F.col("letters").alias("_l"), F.col("hyp").alias("_h"))
    joined = rows.join(t, "example_idx")
    cut = lambda c, m: T.window_slice(F.col(c), F.col("start_pos"), F.col("end_pos"), F.col("is_revcomp"), m)
    return joined.withColumn("letters", cut("_l", False)).withColumn("hyp", cut("_h", True)).drop("_l", "_h")


def graph_of(rows: DataFrame, tracks: DataFrame, sign: int, o: Options, filtered: bool) -> tuple[DataFrame, DataFrame]:
    """(weighted edges, ids kept) of seqlets (id, coordinates)."""
    full = kept(hydrate(rows, tracks), "hydrated")
    contrib = T.contributions(F.col("letters"), F.col("hyp"))
    base = full.select("id", "letters", T.attribution(contrib).alias("importance"))
    forward, reverse = (kept(gkmers.seqlet_gkmers(base, sign=sign, forward=f), "gkmers") for f in (True, False))
    coarse = kept(gkmers.coarse_knn(forward, reverse, rows.select("id"), o.neighbours + 1), "coarse")
    flat = lambda h, c: F.flatten(F.zip_with(h, c, lambda a, b: F.concat(a, b)))
    l1 = lambda m: F.transform(m, lambda r: F.transform(r, lambda x: x.cast("double")))

    def scaled(m):
        return T.let(T.total(F.flatten(m), F.abs), lambda size: F.transform(m, lambda r: F.transform(r, lambda x: F.when(size == 0, F.lit(0.0)).otherwise(x / size))))

    h, c = scaled(l1(F.col("hyp"))), scaled(contrib)
    feats = kept(full.select("id", flat(h, c).alias("fwd"), flat(T.revcomp_matrix(h), T.revcomp_matrix(c)).alias("rev"), F.size("letters").alias("n")), "features")
    positions = feats.agg(F.max("n")).first()[0] or 0
    fine = kept(similarity.fine_similarity(coarse, feats, positions=positions, width=8, min_overlap=o.min_overlap), "fine")
    ids = rows.select("id")
    if filtered:
        good = kept(similarity.correlation_filter(coarse, fine, o.correlation), "good")
        ids = good
        fine = fine.join(good.withColumnRenamed("id", "i"), "i", "left_semi").join(good.withColumnRenamed("id", "j"), "j", "left_semi")
    edges = kept(density.symmetrise(density.distances(fine), "d"), "edges")
    betas = ids.select(F.col("id").alias("i")).join(density.precisions(edges, o.perplexity), "i", "left").withColumn("beta", F.coalesce("beta", F.lit(2.0**-100)))
    return kept(density.density_weights(edges, kept(betas, "betas")), "graph"), ids


def _tracks_of(frame: pd.DataFrame) -> B.Tracks:
    out = B.Tracks()
    for e, letters, hyp in zip(frame["example_idx"], frame["track_letters"], frame["track_hyp"], strict=True):
        if e not in out:
            letters, hyp = np.asarray(letters), np.stack([np.asarray(r, dtype=np.float64) for r in hyp])
            out[int(e)] = ((letters[:, None] == np.arange(4)).astype(np.float64), hyp)
    return out


def _seqlets_of(frame: pd.DataFrame) -> list[B.Seqlet]:
    return [B.Seqlet(int(e), int(s), int(t), bool(r)) for e, s, t, r in zip(frame["example_idx"], frame["start_pos"], frame["end_pos"], frame["is_revcomp"], strict=True)]


def _rows_of(patterns: list[B.Pattern], first: int = 0) -> pd.DataFrame:
    rows = [(first + k, -1, n, s.example, s.start, s.end, s.rc) for k, p in enumerate(patterns) for n, s in enumerate(p.seqlets)]
    return pd.DataFrame(rows, columns=["pattern", "subpattern", "ord", "example_idx", "start_pos", "end_pos", "is_revcomp"])


def with_tracks(rows: DataFrame, tracks: DataFrame) -> DataFrame:
    return rows.join(tracks.select("example_idx", F.col("letters").alias("track_letters"), F.col("hyp").alias("track_hyp")), "example_idx")


def build(clustered: DataFrame, tracks: DataFrame, sign: int, background: list[float], o: Options) -> DataFrame:
    """Clusters (community, id, strength, coordinates) -> members of polished patterns of the right sign."""
    q = np.array(background)

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        held = _tracks_of(frame)
        order = _seqlets_of(frame.sort_values(["strength", "id"], ascending=[False, True]))
        pattern = B.merge(B.Pattern(held, order[:1]), order[1:], metric="jaccard", min_overlap=o.min_overlap)
        pattern = B.polish(pattern, min_share=o.min_share, min_n=o.min_n, flank=o.initial_flank, window=o.trim, background=q)
        if pattern is None or np.sign(pattern.sums[1].sum()) != sign:
            return _rows_of([])
        return _rows_of([pattern], int(frame["community"].iloc[0]))

    return with_tracks(clustered, tracks).groupBy("community").applyInPandas(fold, MEMBERS)


def _scored(members: DataFrame, tracks: DataFrame, todo: list[tuple[int, int]], o: Options) -> dict[tuple[int, int], tuple[float, float]]:
    """(similarity, auroc) of ordered pairs of patterns, a task per pair."""
    pairs = members.sparkSession.createDataFrame([(k, a, b) for k, (a, b) in enumerate(todo)], "pair int, a int, b int")
    sides = pairs.select("pair", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("pattern")), F.struct(F.lit(1).alias("side"), F.col("b").alias("pattern")))).alias("x")).select("pair", "x.side", "x.pattern")

    def score(frame: pd.DataFrame) -> pd.DataFrame:
        held = _tracks_of(frame)
        i, j = (B.Pattern(held, _seqlets_of(frame[frame["side"] == k].sort_values("ord"))) for k in (0, 1))
        sim, auroc = B.pattern_pair(i, j, o.merge_sample, min_overlap=o.min_overlap)
        return pd.DataFrame({"pair": [frame["pair"].iloc[0]], "sim": [sim], "auroc": [auroc]})

    found = with_tracks(sides.join(members, "pattern"), tracks).groupBy("pair").applyInPandas(score, "pair int, sim double, auroc double").collect()
    return {todo[r.pair]: (r.sim, r.auroc) for r in found}


def collapse(members: DataFrame, tracks: DataFrame, background: list[float], o: Options) -> DataFrame:
    """Merge similar patterns until nothing merges.

    Where members have a column `parent`, only patterns of one parent merge with each other; all parents go through their
    rounds in the same Spark jobs. A round scores the ordered pairs of patterns that are new (a task per pair), plans the
    merges of each parent on its small score matrix on the driver, and carries the plan out in its order, a task per set
    of patterns that it connects. A merge of which polishing leaves nothing is refused: both sides stay, with all members,
    and the pair is not tried again. A parent is done when its plan holds no pair that has not been refused.
    """
    q = np.array(background)
    spark = members.sparkSession
    nested = "parent" in members.columns
    if not nested:
        members = members.withColumn("parent", F.lit(0))
    schema = f"parent int, {MEMBERS}"
    fields = [c.split()[0] for c in schema.split(", ")]
    members = members.select(*fields)
    scores: dict[tuple[int, int], tuple[float, float]] = {}
    refused: set[frozenset[int]] = set()
    order: dict[int, list[int]] = {}  # parent -> its patterns
    for r in members.groupBy("parent", "pattern").count().orderBy("parent", "pattern").collect():  # a row per pattern
        order.setdefault(r.parent, []).append(r.pattern)
    fresh = max((name for names in order.values() for name in names), default=-1) + 1
    going = set(order)
    while going:  # every round leaves fewer patterns, or fewer pairs to try
        todo = [(a, b) for parent in sorted(going) for a in order[parent] for b in order[parent] if a != b and (a, b) not in scores]
        if todo:
            scores |= _scored(members, tracks, todo, o)
        plan: list[tuple[int, int, int, int]] = []  # parent, both sides, name of the merged pattern
        for parent in sorted(going):
            names = order[parent]
            sim, auroc = np.eye(len(names)), np.full((len(names), len(names)), 0.5)
            for x, a in enumerate(names):
                for y, b in enumerate(names):
                    if a != b:
                        sim[x, y], auroc[x, y] = scores.get((a, b), (0.0, 0.5))
            pairs = [(names[x], names[y]) for x, y in B.merge_plan(sim, auroc)]
            if all(frozenset(p) in refused for p in pairs):
                going.discard(parent)
                continue
            plan += [(parent, a, b, fresh + len(plan) + k) for k, (a, b) in enumerate(pairs)]
        if not plan:
            break
        fresh = plan[-1][3] + 1
        group = B.components((a, b) for _, a, b, _ in plan)
        steps: dict[int, list[tuple[int, int, int]]] = {}
        for _, a, b, name in plan:
            steps.setdefault(group[a], []).append((a, b, name))
        where = spark.createDataFrame(sorted(group.items()), "pattern int, together int")  # a row per pattern
        tried = frozenset(refused)

        def carry_out(frame: pd.DataFrame) -> pd.DataFrame:
            held = _tracks_of(frame)
            parts = {int(name): B.Pattern(held, _seqlets_of(g.sort_values("ord"))) for name, g in frame.groupby("pattern")}

            def join(x: B.Pattern, y: B.Pattern) -> B.Pattern | None:
                large, small = (y, x) if len(x.seqlets) < len(y.seqlets) else (x, y)
                new = B.merge(large, small.seqlets, metric="pearson", min_overlap=o.min_overlap, hypothetical=False)
                return B.polish(new, min_share=o.min_share, min_n=o.min_n, flank=o.initial_flank, window=o.trim, background=q)

            slot, found, said = B.replay(parts, steps[int(frame["together"].iloc[0])], join, tried)
            out = pd.concat([_rows_of([p], name) for name, p in found.items()])
            notes = [(*pair, -1) for pair in said] + [(a, b, -2) for a, b in slot.items()]  # what the driver hears: ord < 0
            notes = pd.DataFrame([(a, b, kind, 0, 0, 0, False) for a, b, kind in notes], columns=list(out.columns))
            return pd.concat([out, notes]).assign(parent=frame["parent"].iloc[0])[fields]

        met = members.join(F.broadcast(where), "pattern")
        done = kept(with_tracks(met, tracks).groupBy("together").applyInPandas(carry_out, schema), "merged")
        slots: dict[int, int] = {}
        for r in done.where("ord < 0").collect():  # at most a row per pattern and per planned pair
            if r.ord == -1:
                refused.add(frozenset((r.pattern, r.subpattern)))
            else:
                slots[r.pattern] = r.subpattern
        members = kept(members.join(F.broadcast(where), "pattern", "left_anti").select(*fields).unionByName(done.where("ord >= 0")), "collapsed")
        sizes = {r.pattern: r["count"] for r in members.groupBy("pattern").count().collect()}
        for parent in going:
            now = list(dict.fromkeys(slots.get(name, name) for name in order[parent]))
            order[parent] = sorted(now, key=lambda name: -sizes.get(name, 0))
    return members if nested else members.drop("parent")


def subclusters(members: DataFrame, tracks: DataFrame, o: Options, min_size: int = 0) -> DataFrame:
    """Members of patterns with more than min_size seqlets, with their subpattern: communities of a pattern's own
    seqlets under conditional probabilities; bounded by the cap on seqlets."""

    def split(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ord")
        held, order = _tracks_of(frame), _seqlets_of(frame)
        n = len(order)
        out = frame[["pattern", "subpattern", "ord", "example_idx", "start_pos", "end_pos", "is_revcomp"]].copy()
        out["subpattern"] = 0
        if n < 4:
            return out
        x = np.stack([B.features(held.read(s)).ravel() for s in order])
        perplexity = min(o.subcluster_perplexity, (n - 1) / 3)
        k = min(n - 1, int(3 * perplexity + 1))
        near, sims = similarity.nearest(x, k)
        d = np.maximum(np.log(2 / np.maximum(sims, 1e-7) - 1), 0)
        p = _conditional(d, perplexity)
        rows = np.repeat(np.arange(n), k)
        src, dst, w = np.r_[rows, near.ravel()], np.r_[near.ravel(), rows], np.r_[p.ravel(), p.ravel()]
        g = community.Graph(n, src, dst, w / w.sum())
        runs = [community.leiden(g, seed * 100) for seed in range(o.n_seeds)]
        label = max(runs, key=lambda r: round(g.quality(r), 12))
        out["subpattern"] = label
        return out

    sizes = members.groupBy("pattern").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > min_size).select("pattern")
    big = members.join(F.broadcast(sizes), "pattern", "left_semi")  # a row per pattern
    return with_tracks(big, tracks).groupBy("pattern").applyInPandas(split, MEMBERS)


def _conditional(d: np.ndarray, perplexity: float) -> np.ndarray:
    """Row-normalised exp(-d * beta) at the given perplexity, by bisection per row."""
    n, goal = len(d), np.log(perplexity)
    beta, low, high = np.ones(n), np.full(n, -np.inf), np.full(n, np.inf)
    for _ in range(100):
        e = np.exp(-(d - d.min(axis=1, keepdims=True)) * beta[:, None])
        z = e.sum(axis=1)
        entropy = np.log(z) + beta * ((d - d.min(axis=1, keepdims=True)) * e).sum(axis=1) / z
        up = entropy > goal
        low, high = np.where(up, beta, low), np.where(up, high, beta)
        beta = np.where(np.isinf(high), beta * 2, np.where(np.isinf(low), beta / 2, (low + high) / 2))
    e = np.exp(-(d - d.min(axis=1, keepdims=True)) * beta[:, None])
    return e / e.sum(axis=1, keepdims=True)


def background_of(rows: DataFrame, tracks: DataFrame) -> list[float]:
    """Shares of the letters in the seqlets."""
    return background_over(hydrate(rows, tracks))


def background_over(tracks: DataFrame) -> list[float]:
    """Shares of the letters in whole tracks, or in whatever rows have letters."""
    counts = tracks.select(F.explode("letters").alias("b")).groupBy("b").count().collect()
    found = np.bincount([r.b for r in counts], weights=[r["count"] for r in counts], minlength=4).astype(float)
    return np.maximum(found / max(found.sum(), 1.0), 1e-6).tolist()


def discover(tracks: DataFrame, o: Options = Options()) -> DataFrame:
    """tracks (example_idx, letters array<int>, hyp array<array<double>>) -> members of all patterns: metacluster, pattern
    (by size), subpattern, ord and coordinates. Metaclusters of at most min_metacluster seqlets give none."""
    found = extract(tracks, o)
    sizes = {r.metacluster: r["count"] for r in found.groupBy("metacluster").count().collect()}
    out = None
    for name, sign in (("pos", 1), ("neg", -1)):
        if sizes.get(name, 0) <= o.min_metacluster:
            continue
        part = patterns_of(found.where(F.col("metacluster") == name).withColumn("id", F.col("ord").cast("bigint")), tracks, sign, o)
        if part is not None:
            part = part.select(F.lit(name).alias("metacluster"), *part.columns)
            out = part if out is None else out.unionByName(part)
    return out if out is not None else tracks.sparkSession.createDataFrame([], f"metacluster string, {MEMBERS}")


def _strength(rows: DataFrame, tracks: DataFrame) -> DataFrame:
    contrib = F.flatten(T.contributions(F.col("letters"), F.col("hyp")))
    return hydrate(rows, tracks).withColumn("strength", F.round(T.total(contrib, F.abs), 9)).drop("letters", "hyp")


def patterns_of(rows: DataFrame, tracks: DataFrame, sign: int, o: Options) -> DataFrame | None:
    """Two rounds of graph, communities and merging, then splitting, collapsing, filtering and subpatterns."""
    columns = ["id", "example_idx", "start_pos", "end_pos", "is_revcomp"]
    q = background_of(rows, tracks)
    strong = _strength(rows.select(*columns), tracks)
    rank = F.row_number().over(Window.orderBy(F.desc("strength"), "id")) - 1  # bounded by max_seqlets
    rows = kept(strong.withColumn("id", rank.cast("bigint")).select(*columns, "strength"), "ranked")
    members = None
    for nth in range(o.rounds):
        if rows.isEmpty():
            return None
        edges, ids = graph_of(rows, tracks, sign, o, filtered=nth == 0)
        if ids.isEmpty():
            return None
        labels = community.communities(edges, o.n_seeds)
        clustered = rows.join(labels.withColumnRenamed("node", "id"), "id")
        members = kept(build(clustered, tracks, sign, q, o), "members")
        if members.isEmpty():
            return None
        keys = ("example_idx", "start_pos", "end_pos")
        distinct = members.groupBy(*keys).agg(F.min(F.struct("pattern", "ord")).alias("first"), F.max_by("is_revcomp", F.struct("pattern", "ord")).alias("is_revcomp"))
        order = F.row_number().over(Window.orderBy("first.pattern", "first.ord")) - 1  # bounded by max_seqlets
        again = distinct.withColumn("id", order.cast("bigint"))
        rows = kept(_strength(again.select(*columns), tracks).select(*columns, "strength"), "again")
    # split patterns that hold several kinds of seqlets, merge within each, then over all
    split = kept(subclusters(members, tracks, o, min_size=max(o.min_support, 50)), "split")
    rest = members.join(split.select("pattern").distinct(), "pattern", "left_anti")
    inner = collapse(kept(_renamed(split.withColumn("parent", F.col("pattern")), "parent", "subpattern"), "refined"), tracks, q, o)
    both = inner.unionByName(rest.withColumn("parent", F.col("pattern")))
    members = collapse(kept(_renamed(both, "parent", "size desc", "pattern").drop("parent"), "again"), tracks, q, o)
    members = kept(members, "merged")
    good = filtered(members, tracks, q, o)
    final = members.join(F.broadcast(good), "pattern").drop("pattern").withColumnRenamed("place", "pattern")  # a row per pattern
    grown = expand_final(final, tracks, o) if o.final_flank else final
    return kept(subclusters(grown.select("pattern", "subpattern", "ord", "example_idx", "start_pos", "end_pos", "is_revcomp"), tracks, o), "patterns")


def _renamed(members: DataFrame, *order: str) -> DataFrame:
    """Patterns (parent, pattern, subpattern) under new numbers by the order given, members numbered anew within each."""
    keys = ["parent", "pattern", "subpattern"]
    names = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
    nth = F.row_number().over(Window.orderBy(*[F.expr(c.split()[0]).desc() if c.endswith(" desc") else F.col(c) for c in order])) - 1  # a row per pattern
    named = members.join(F.broadcast(names.select(*keys, nth.cast("int").alias("name"))), keys)
    place = F.row_number().over(Window.partitionBy("name").orderBy("ord")) - 1
    return named.select("parent", F.col("name").alias("pattern"), F.lit(-1).alias("subpattern"), place.cast("int").alias("ord"), "example_idx", "start_pos", "end_pos", "is_revcomp")


def expand_final(members: DataFrame, tracks: DataFrame, o: Options) -> DataFrame:
    """Flanks on both sides of every member; those that leave their track go, and patterns without members with them."""
    length = tracks.select("example_idx", F.size("letters").alias("_len"))
    return seqlets.expand(members.join(length, "example_idx"), F.lit(o.final_flank), F.lit(o.final_flank), F.col("_len")).drop("_len")


def filtered(members: DataFrame, tracks: DataFrame, background: list[float], o: Options) -> DataFrame:
    """(pattern, place): patterns with enough seqlets and information, in order of size."""
    long = hydrate(members, tracks).select("pattern", F.posexplode("letters").alias("pos", "letter"))
    bases = F.transform(F.array(*map(F.lit, range(4))), lambda b: (F.col("letter") == b).cast("double"))
    ppm = long.select("pattern", "pos", F.posexplode(bases).alias("base", "hit")).groupBy("pattern", "pos", "base").agg(F.avg("hit").alias("mean"))
    q = F.element_at(F.array(*map(F.lit, background)), F.col("base") + 1)
    from ..operators import patterns as P

    ic = P.information(ppm, q, "pattern", "pos")
    best = P.best_window(ic, o.ic_window, "pattern").where(F.col("ic") >= o.min_ic)
    sizes = members.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= o.min_support)
    return sizes.join(best, "pattern").select("pattern", (F.row_number().over(Window.orderBy(F.desc("n"), "pattern")) - 1).cast("int").alias("place"))
