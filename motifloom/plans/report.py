"""HTML reports over a results store: pattern statistics, logos as inline SVG, histograms, examples and motif matches.

Statistics are Spark aggregates; only a row per pattern and bin reaches the driver, which writes the page.
"""

from __future__ import annotations

import html

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tracks as T
from ..operators import matching
from ..sources import store
from ..sources.shared import kept
from ..sources.text import read_motifs, read_tomtom_tables, write_text, write_tomtom

COLOURS = {"A": "#109648", "C": "#255c99", "G": "#f7b32b", "T": "#d62839"}


def logo_svg(matrix: np.ndarray, width: int = 16, height: int = 80) -> str:
    """A sequence logo: letters stacked by size, negative ones below the axis."""
    top = max(1e-9, np.where(matrix > 0, matrix, 0).sum(axis=1).max(initial=0), np.where(matrix < 0, -matrix, 0).sum(axis=1).max(initial=0))
    below = bool((matrix < 0).any())
    base, scale = (height / 2, height / 2 / top) if below else (height, height / top)
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width * len(matrix)}" height="{height}">']
    for p, row in enumerate(matrix):
        up, down = base, base
        for b in np.argsort(np.abs(row)):
            size = abs(float(row[b])) * scale
            if size < 0.5:
                continue
            letter = "ACGT"[b]
            if row[b] > 0:
                y, up = up, up - size
            else:
                down += size
                y = down
            out.append(f'<text transform="translate({p * width},{y:.1f}) scale({width / 10:.2f},{size / 10:.3f})" font-family="monospace" font-weight="bold" font-size="14" fill="{COLOURS[letter]}">{letter}</text>')
    return "".join(out) + "</svg>"


def bars_svg(counts: list[float], width: int = 240, height: int = 80) -> str:
    top, w = max([*counts, 1e-9]), width / max(1, len(counts))
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">' + "".join(f'<rect x="{k * w:.1f}" y="{height - c / top * height:.1f}" width="{w * 0.9:.1f}" height="{c / top * height:.1f}" fill="#255c99"/>' for k, c in enumerate(counts)) + "</svg>"


def with_importance(values: DataFrame) -> DataFrame:
    """Adds importance, the sum of a member's absolute contributions."""
    return values.withColumn("importance", T.total(F.flatten("contrib_scores"), F.abs))


def seqlet_stats(values: DataFrame) -> DataFrame:
    """Per pattern of a store's seqlet_values: n, gc_content (mean of the C and G columns), gc_fraction, mean and standard
    deviation of the members' importance."""
    gc = F.size(F.filter("letters", lambda b: (b == 1) | (b == 2))) / F.size("letters")
    found = with_importance(values).groupBy("metacluster", "pattern").agg(
        F.count(F.lit(1)).alias("n"), F.avg(gc).alias("gc_fraction"), F.stddev_pop("importance").alias("std_importance"), F.avg("importance").alias("mean_importance")
    )
    return found.withColumn("gc_content", F.col("gc_fraction") / 2)


def importance_histograms(values: DataFrame, bins: int = 30) -> DataFrame:
    """metacluster, pattern, least, most, counts: a pattern's importances in equal bins between its least and most."""
    rows = with_importance(values).select("metacluster", "pattern", "importance")
    ends = rows.groupBy("metacluster", "pattern").agg(F.min("importance").alias("least"), F.max("importance").alias("most"))
    width = F.greatest((F.col("most") - F.col("least")) / bins, F.lit(1e-12))
    at = F.least(F.floor((F.col("importance") - F.col("least")) / width), F.lit(bins - 1)).cast("int")
    keys = ("metacluster", "pattern", "least", "most")
    counts = rows.join(ends, ["metacluster", "pattern"]).groupBy(*keys, at.alias("bin")).agg(F.count(F.lit(1)).alias("k"))
    return counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", "k"))).alias("counts"))


def member_examples(values: DataFrame, n: int = 10) -> DataFrame:
    """metacluster, pattern, place, importance, contrib_scores of the members at the percentiles of importance, highest
    first. Only keys are ranked; the chosen members' matrices are joined to them."""
    keys = ("metacluster", "pattern", "ord")
    chosen = quantile_examples(with_importance(values).select(*keys, "importance"), n, by=("metacluster", "pattern"), value="importance")
    return chosen.join(values.select(*keys, "contrib_scores"), list(keys)).drop("ord")


def extent(members: DataFrame) -> DataFrame:
    """(least, most, middle) over all members: where the regions lie; 400 and 200 stand in for no members."""
    found = members.agg(F.min("start_pos").alias("least"), F.max("end_pos").alias("most"))
    return found.select(F.coalesce("least", F.lit(0)).alias("least"), F.coalesce("most", F.lit(400)).alias("most")).withColumn("middle", (F.col("least") + F.col("most")) / 2)


def distances(members: DataFrame) -> DataFrame:
    """Per pattern: median and standard deviation of the distance to the middle."""
    rows = members.crossJoin(F.broadcast(extent(members)))  # one row
    d = F.abs((F.col("start_pos") + F.col("end_pos")) / 2 - F.col("middle"))
    return rows.withColumn("d", d).groupBy("metacluster", "pattern").agg(F.percentile("d", 0.5).alias("median_distance"), F.stddev_pop("d").alias("std_distance"))


def histograms(members: DataFrame, bins: int = 30) -> DataFrame:
    """metacluster, pattern, counts: positions of the members over the whole extent in equal bins."""
    rows = members.crossJoin(F.broadcast(extent(members)))  # one row
    middle = (F.col("start_pos") + F.col("end_pos")) / 2
    at = F.least(F.floor((middle - F.col("least")) / F.greatest((F.col("most") - F.col("least")) / bins, F.lit(1e-9))), F.lit(bins - 1)).cast("int")
    counts = rows.groupBy("metacluster", "pattern", at.alias("bin")).agg(F.count(F.lit(1)).alias("k"))
    return counts.groupBy("metacluster", "pattern").agg(F.map_from_entries(F.collect_list(F.struct("bin", "k"))).alias("counts"))


def quantile_examples(rows: DataFrame, n: int = 10, *, by: tuple[str, ...], value: str) -> DataFrame:
    """The members nearest to the percentiles linspace(10, 100, n) of a value, each once, highest first."""
    order = Window.partitionBy(*by).orderBy(value, *[c for c in rows.columns if c not in (*by, value)])
    ranked = rows.withColumn("_r", F.row_number().over(order) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    goals = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.floor((10 + k * (90 / max(1, n - 1))) / 100 * (F.col("_n") - 1) + 0.5).cast("int"))
    return ranked.where(F.array_contains(goals, F.col("_r").cast("int"))).withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_r")))).drop("_r", "_n")


def _table(columns: list[str], rows: list[list[str]]) -> str:
    cells = "".join("<tr>" + "".join(f"<td>{c}</td>" for c in row) + "</tr>" for row in rows)
    return "<table border=1><tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in columns) + f"</tr>{cells}</table>"


def match_logos(motifs: DataFrame, names: set[str]) -> dict[str, str]:
    """Logos of the named motifs, letters as high as their share of the position's information."""
    even = F.array(*[F.lit(0.25)] * 4)
    scaled = F.transform("pwm", lambda row: T.let(T.position_ic(row, even), lambda ic: F.transform(row, lambda p: p * ic)))
    rows = motifs.where(F.col("name").isin(*sorted(names))).select("name", scaled.alias("m")).collect()  # a few per pattern
    return {r.name: logo_svg(np.array(r.m, dtype=float)) for r in rows}


def write_report(
    spark: SparkSession, path: str, out: str, *, motif_db: str | None = None, n_matches: int = 3, euclidean: bool = False,
    trim_threshold: float = 0.3, simple: bool = False, n_examples: int = 10, tomtom: bool = False, tables: str | None = None,
) -> str:
    """Write report.html (or motifs.html) under out; returns the page.

    The whole report shows where members lie, how their importance spreads, and n_examples of them per pattern. Matches
    by correlation are those of E-values up to 10; with tomtom each pattern's go to out/tomtom as a table, too.
    With `tables` the matches are those of TOMTOM tables made elsewhere, by the pattern's name in the file's; motif_db then
    only gives their logos.
    """
    patterns = store.load(spark, path, "patterns").orderBy(F.desc("metacluster"), "pattern").collect()  # a row per pattern
    members = store.load(spark, path, "seqlets")
    values = store.load(spark, path, "seqlet_values")
    names = [f"{p.metacluster}_patterns.pattern_{p.pattern}" for p in patterns]
    matrices = {n: tuple(np.array(m, dtype=float) for m in (p.sequence, p.contrib_scores)) for n, p in zip(names, patterns, strict=True)}
    matches: dict[str, dict] = {}
    logos: dict[str, str] = {}
    if tables and names:
        found = read_tomtom_tables(spark, tables).where(F.col("query").isin(*names))
        best = matching.top_matches(found, n_matches, order="place")
        matches = {r["query"]: r.asDict() for r in best.withColumn("name", matching.descriptive_name(n_matches)).collect()}
        wanted = {m[f"match{k}"] for m in matches.values() for k in range(n_matches)} - {None}
        logos = match_logos(read_motifs(spark, motif_db), wanted) if motif_db and wanted else {}
    elif motif_db and names:
        queries = {n: matching.support(s, c, trim_threshold) for n, (s, c) in matrices.items()}
        motifs = read_motifs(spark, motif_db)
        found = matching.match_motifs(queries, motifs, how="euclidean" if euclidean else "pearson")
        found = kept(matching.within_evalue(found, motifs.count(), float("inf") if euclidean else 10.0), "matches")
        for name in names if tomtom else ():
            write_tomtom(found.where(F.col("query") == name), f"{out}/tomtom/{name}.tomtom.tsv")
        best = matching.top_matches(found, n_matches)
        matches = {r["query"]: r.asDict() for r in best.withColumn("name", matching.descriptive_name(n_matches)).collect()}
        logos = match_logos(motifs, {m[f"match{k}"] for m in matches.values() for k in range(n_matches)} - {None})
    where = {(r.metacluster, r.pattern): r for r in distances(members).collect()}
    bars = {(r.metacluster, r.pattern): r.counts for r in histograms(members).collect()}
    stats, spread, shown = {}, {}, {}
    if not simple:
        stats = {(r.metacluster, r.pattern): r for r in seqlet_stats(values).collect()}
        spread = {(r.metacluster, r.pattern): r for r in importance_histograms(values).collect()}
        for r in member_examples(values, n_examples).orderBy("metacluster", "pattern", "place").collect():  # n_examples a pattern
            shown.setdefault((r.metacluster, r.pattern), []).append(r)
    matched = bool(motif_db or tables)
    columns = ["pattern", "seqlets", "forward", "reverse"] if simple else ["pattern", "seqlets", "contributions", "sequence", "median distance", "positions", "GC", "importance"]
    columns += [f"{k}{m}" for m in range(n_matches) for k in ("match", "q-value ")] * matched
    rows, sections = [], []
    for p, name in zip(patterns, names, strict=True):
        key, match = (p.metacluster, p.pattern), matches.get(name, {})
        seq, con = matrices[name]
        row = [html.escape(match.get("name") or name), str(p.n_seqlets), logo_svg(matching.support(con, con, trim_threshold, (2, 3)))]
        if simple:
            back = con[::-1, ::-1]
            row.append(logo_svg(matching.support(back, back, trim_threshold, (2, 3))))
        else:
            row.append(logo_svg(matching.support(seq, con, trim_threshold, (2, 3))))
            row += [f"{where[key].median_distance:.1f} ± {where[key].std_distance:.1f}", bars_svg([bars[key].get(b, 0) for b in range(30)])]
            row += [f"{stats[key].gc_content:.3f}", f"{stats[key].mean_importance:.3g} ± {stats[key].std_importance:.3g}"] if key in stats else ["", ""]
            sections.append(_section(name, spread.get(key), shown.get(key, [])))
        for m in range(n_matches) if matched else ():
            target, q = match.get(f"match{m}"), match.get(f"qval{m}")
            row += [html.escape(target or "") + logos.get(target, ""), "" if q is None else f"{q:.3g}"]
        rows.append(row)
    body = _table(columns, rows) + "".join(sections) if rows else "<p>No patterns.</p>"
    page = f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Patterns</title></head><body><h1>Patterns</h1>{body}</body></html>"
    write_text(spark, page, f"{out}/{'motifs' if simple else 'report'}.html")
    return page


def _section(name: str, spread, examples: list) -> str:
    """A pattern's spread of importance and its examples; empty where the store has no members' values."""
    if spread is None:
        return ""
    bars = f"<p>importance {spread.least:.3g} to {spread.most:.3g}</p>" + bars_svg([spread.counts.get(b, 0) for b in range(30)])
    rows = [[str(r.place), f"{r.importance:.3g}", logo_svg(np.array(r.contrib_scores, dtype=float))] for r in examples]
    return f"<h2>{html.escape(name)}</h2>{bars}" + _table(["example", "importance", "contributions"], rows)
