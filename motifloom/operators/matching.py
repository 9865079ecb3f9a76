"""Matching patterns to a motif database: best offset and strand by column correlation, p-values from the null of
column scores, q-values over the database.

The score of a column pair is their Pearson correlation (or minus their Euclidean distance). A match's p-value is the
chance that as many random columns of the database score as much in sum, by convolving binned column scores, corrected
for the offsets and strands tried. Patterns are few; the database is dealt over tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MATCHES = "query string, target string, score double, offset int, is_rc boolean, pval double"


def support(matrix: np.ndarray, contrib: np.ndarray, share: float = 0.3, pad: tuple[int, int] = (0, 0)) -> np.ndarray:
    """The rows between the first and last position whose contribution reaches share of the largest, with pads."""
    size = np.abs(contrib).sum(axis=1)
    good = np.flatnonzero(size >= size.max() * share)
    return matrix[max(0, good[0] - pad[0]) : good[-1] + 1 + pad[1]]


def column_scores(a: np.ndarray, b: np.ndarray, how: str = "pearson") -> np.ndarray:
    """[rows of a, rows of b]."""
    if how == "euclidean":
        return -np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    x, y = a - a.mean(axis=1, keepdims=True), b - b.mean(axis=1, keepdims=True)
    size = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None]
    return np.divide(x @ y.T, size, out=np.zeros((len(a), len(b))), where=size > 0)


def best_match(query: np.ndarray, target: np.ndarray, tails: list[np.ndarray], low: float, high: float, min_overlap: int, how: str) -> tuple[float, int, bool, float]:
    """(p-value, offset, reverse, score); tails[a * n + b] is the null's upper tail for query rows a to b."""
    n, found = len(query), (2.0, 0, False, 0.0)
    tried = 0
    for reverse in (False, True):
        scores = column_scores(query, target[::-1, ::-1] if reverse else target, how)
        for offset in range(-len(target) + 1, n):
            a, b = max(0, offset), min(n, offset + len(target))
            if b - a < min(min_overlap, n, len(target)):
                continue
            tried += 1
            total = float(scores[np.arange(a, b), np.arange(a, b) - offset].sum())
            tail = tails[a * (n + 1) + b]
            at = int(np.floor((total - (b - a) * low) / (high - low) * BINS + 1e-9))
            p = float(tail[min(max(at, 0), len(tail) - 1)])
            if p < found[0]:
                found = (p, offset, reverse, total)
    return (1 - (1 - min(found[0], 1.0)) ** max(tried, 1), *found[1:])


BINS = 100


def null_tails(query: np.ndarray, columns: np.ndarray, how: str, low: float, high: float, counts: np.ndarray | None = None) -> list[np.ndarray]:
    """For every run of query rows, the upper tail of the sum of its scores with random database columns, each as likely
    as it is frequent (counts; all alike without)."""
    counts = np.ones(len(columns)) if counts is None else counts
    scores = np.clip(((column_scores(query, columns, how) - low) / (high - low) * BINS + 1e-9).astype(int), 0, BINS - 1)  # as in best_match, an edge counts as above
    single = [np.bincount(row, weights=counts, minlength=BINS) / counts.sum() for row in scores]
    n = len(query)
    tails = [np.ones(1)] * ((n + 1) * (n + 1))
    for a in range(n):
        dist = np.ones(1)
        for b in range(a + 1, n + 1):
            dist = np.convolve(dist, single[b - 1])
            tails[a * (n + 1) + b] = np.cumsum(dist[::-1])[::-1]
    return tails


def match_motifs(queries: dict[str, np.ndarray], motifs: DataFrame, *, min_overlap: int = 5, how: str = "pearson") -> DataFrame:
    """(query, target, score, offset, is_rc, pval, qval) of every query against every motif (name, pwm).

    The null's columns are all of the database's, rounded to hundredths, with how often each occurs: of probabilities
    there are at most 176 851 different ones, whatever the database.
    """
    spark = motifs.sparkSession
    cells = motifs.select(F.explode("pwm").alias("c")).select(F.transform("c", lambda x: F.round(x, 2)).alias("c")).groupBy("c").count().orderBy("c").collect()
    columns, counts = np.array([r.c for r in cells], dtype=float).reshape(-1, 4), np.array([r["count"] for r in cells], dtype=float)
    low, high = (-1.0, 1.0) if how == "pearson" else (-np.sqrt(2.0), 0.0)
    tails = {name: null_tails(q, columns, how, low, high, counts) for name, q in queries.items()}
    shared = spark.sparkContext.broadcast((queries, tails))  # patterns only

    def run(batches):
        for batch in batches:
            out = []
            for name, pwm in zip(batch["name"], batch["pwm"], strict=True):
                target = np.stack([np.asarray(r, dtype=float) for r in pwm])
                for query, matrix in shared.value[0].items():
                    p, offset, rc, score = best_match(matrix, target, shared.value[1][query], low, high, min_overlap, how)
                    out.append((query, name, score, offset, rc, p))
            yield pd.DataFrame(out, columns=["query", "target", "score", "offset", "is_rc", "pval"])

    found = motifs.select("name", "pwm").mapInPandas(run, MATCHES)
    return with_qvalues(found)


def with_qvalues(matches: DataFrame) -> DataFrame:
    """Benjamini-Hochberg per query."""
    w = Window.partitionBy("query").orderBy("pval", "target")
    raw = F.col("pval") * F.count(F.lit(1)).over(Window.partitionBy("query")) / F.row_number().over(w)
    from_here = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return matches.withColumn("_q", raw).withColumn("qval", F.least(F.lit(1.0), F.min("_q").over(from_here))).drop("_q")


def within_evalue(matches: DataFrame, motifs: int, most: float = 10.0) -> DataFrame:
    """Matches with their E-value, the p-value times the number of motifs, of at most `most`."""
    return matches.withColumn("evalue", F.col("pval") * motifs).where(F.col("evalue") <= most)


def top_matches(matches: DataFrame, n: int = 3, by: str = "qval", order: str | None = None) -> DataFrame:
    """query, match0.., by0..: the n best targets side by side, null where there are fewer; best by `order` if given."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy(order or by, "target")) - 1
    best = matches.withColumn("rank", rank).where(F.col("rank") < n)
    pick = [F.max(F.when(F.col("rank") == k, F.col(c))).alias(f"{name}{k}") for k in range(n) for c, name in (("target", "match"), (by, by))]
    return best.groupBy("query").agg(*pick)


def descriptive_name(n: int = 3):
    """First ten characters of up to n matches joined by ; - else the query's own name."""
    joined = F.concat_ws(";", *[F.substring(F.col(f"match{k}"), 1, 10) for k in range(n)])
    return F.when(joined != "", joined).otherwise(F.col("query"))
