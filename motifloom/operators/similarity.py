"""Similarities between seqlets or patterns, in blocks.

Comparing a set against itself is dealt as pairs of blocks: each task holds two blocks of packed rows and leaves the best
k per row, so what is shuffled is blocks and short lists, never pairs of rows. The number of blocks does not grow with the
rows until a block is full, so up to there what is shuffled grows as the rows do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept

KNN = "i bigint, j bigint, sim double"


def jaccard_block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Continuous Jaccard of all rows of a with all rows of b; 0 where both are empty."""
    out = np.zeros((len(a), len(b)))
    size_b, sign_b = np.abs(b), np.sign(b)
    for i, row in enumerate(a):
        size = np.abs(row)
        low = (np.minimum(size, size_b) * (np.sign(row) * sign_b)).sum(axis=1)
        high = np.maximum(size, size_b).sum(axis=1)
        out[i] = np.divide(low, high, out=np.zeros(len(b)), where=high > 0)
    return out


def nearest(x: np.ndarray, k: int, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(places, similarities) of the k rows most similar to each row, itself left out, lowest place on ties; only `block` rows
    of the matrix of similarities are held at a time."""
    places, sims = np.empty((len(x), k), dtype=np.int64), np.empty((len(x), k))
    for first in range(0, len(x), block):
        part = jaccard_block(x[first : first + block], x)
        part[np.arange(len(part)), np.arange(first, first + len(part))] = -np.inf
        at = np.argsort(-part, axis=1, kind="stable")[:, :k]
        places[first : first + len(part)], sims[first : first + len(part)] = at, np.take_along_axis(part, at, axis=1)
    return places, sims


def shifted(values: np.ndarray, by: int, width: int) -> np.ndarray:
    """Rows of flat matrices (width values per position) moved right by `by` positions, zeros coming in."""
    out = np.zeros_like(values)
    n, step = values.shape[-1], by * width
    if abs(step) < n:
        out[..., max(0, step) : n + min(0, step)] = values[..., max(0, -step) : n - max(0, step)]
    return out


def jaccard_pairs(x: np.ndarray, y: np.ndarray, pad: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(score, offset) per row pair: the best Jaccard of x against y seen through windows at -pad..pad, first on ties.

    Windows over the zero-padded y: x meets the positions y[o:], and all of x counts in the denominator.
    """
    best, at = np.full(len(x), -np.inf), np.zeros(len(x), dtype=np.int64)
    for o in range(-pad, pad + 1):
        z = shifted(y, -o, width)
        low = (np.minimum(np.abs(x), np.abs(z)) * np.sign(x) * np.sign(z)).sum(axis=1)
        high = np.maximum(np.abs(x), np.abs(z)).sum(axis=1)
        score = np.divide(low, high, out=np.zeros(len(x)), where=high > 0)
        at[score > best], best = o, np.maximum(score, best)
    return best, at


class Best:
    """The k best (sim, j) of each of n rows so far: larger sims first, then smaller j."""

    def __init__(self, n: int, k: int):
        self.sims, self.js = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def take(self, rows: np.ndarray, js: np.ndarray, sims: np.ndarray) -> None:
        k = self.sims.shape[1]
        last, tie = self.sims[rows, -1], self.js[rows, -1]
        good = (sims > last) | ((sims == last) & (js < tie))
        if not good.any():
            return
        rows, js, sims = rows[good], js[good], sims[good]
        touched, at = np.unique(rows, return_inverse=True)
        at = np.r_[np.repeat(np.arange(len(touched)), k), at]
        sims, js = np.r_[self.sims[touched].ravel(), sims], np.r_[self.js[touched].ravel(), js]
        order = np.lexsort((js, -sims, at))
        first = np.searchsorted(at[order], np.arange(len(touched)))
        chosen = order[first[:, None] + np.arange(k)]
        self.sims[touched], self.js[touched] = sims[chosen], js[chosen]

    def found(self, ids: np.ndarray) -> pa.RecordBatch:
        real = np.isfinite(self.sims)
        i = np.repeat(ids, real.sum(axis=1))
        return pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(self.js[real], pa.int64()), pa.array(self.sims[real])], names=["i", "j", "sim"])


def dealt(parts: DataFrame, cells: int) -> DataFrame:
    """Rows by cell, then side and block. Two partitions a cell, so that few cells share one."""
    return parts.repartition(2 * cells, "cell").sortWithinPartitions("cell", "side", "block")


def ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("sim"), "j"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


ROWS, COLUMNS = 512, 1024  # of a tile
LEVELS = 2  # at which sizes are cut
HELD = 20_000  # pairs that wait to be ranked
PAIRS = 8192  # compared at their offsets at once
NEAR = 1024  # rows of a pair of blocks that are compared at once, or that give the first floors


class _Block:
    """Rows that meet others, with their best so far; `floors` are similarities that k others are known to reach."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, floors: np.ndarray | None = None):
        self.ids, self.x, self.best = ids, x, Best(len(ids), k)
        self.floors = np.full(len(ids), -np.inf) if floors is None else floors
        self.ones = np.ones(x.shape[1])
        self.norm = np.abs(x) @ self.ones
        self.single = x.astype(np.float32)

    def project(self, top: float) -> np.ndarray:
        """Columns whose products with those of another row bound their similarity: sizes cut at levels up to `top` with and
        without their signs, roots of what the levels leave of positive and of negative values, the norm, and one."""
        n, width = self.x.shape
        out = np.empty((n, (2 * LEVELS + 2) * width + 2), dtype=np.float32)
        step = 1 / LEVELS
        for first in range(0, n, 4096):
            x = self.x[first : first + 4096] / top
            sign, rest = np.sign(x), np.abs(x)
            rows = out[first : first + 4096]
            size = rest.copy()
            for nth in range(LEVELS):
                part = np.clip(size - nth * step, 0, step) / step**0.5
                rest -= part * part
                rows[:, nth * width : (nth + 1) * width] = part * sign
                rows[:, (LEVELS + nth) * width : (LEVELS + nth + 1) * width] = part
            rest = np.sqrt(np.maximum(rest, 0))
            rows[:, 2 * LEVELS * width : -2 - width] = np.where(sign > 0, rest, 0)
            rows[:, -2 - width : -2] = np.where(sign < 0, rest, 0)
            rows[:, -2] = size @ self.ones
        out[:, -1] = 1
        return out

    def least(self) -> np.ndarray:
        return np.maximum(self.best.sims[:, -1], self.floors)


def _exact(a: _Block, b: _Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Jaccard of pairs: the larger values add up to norms - lesser values, and these less the distance to the numerator."""
    out = np.empty(len(i))
    for first in range(0, len(i), NEAR):
        at = slice(first, first + NEAR)
        x, y = a.x[i[at]], b.x[j[at]]
        high = a.norm[i[at]] + b.norm[j[at]] - np.minimum(np.abs(x), np.abs(y)) @ a.ones
        x -= y
        low = high - np.abs(x, out=x) @ a.ones
        out[at] = np.round(np.divide(low, high, out=np.zeros(len(x)), where=high > 0), 12)
    return out


def _nearly(a: _Block, b: _Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Jaccard of pairs in single precision, from the sums of |x + y| and |x - y|, which are its larger values plus and minus
    its signed lesser ones."""
    out, ones = np.empty(len(i), dtype=np.float32), a.ones.astype(np.float32)
    for first in range(0, len(i), NEAR):
        at = slice(first, first + NEAR)
        x, y = a.single[i[at]], b.single[j[at]]
        both = x + y
        x -= y
        both, apart = np.abs(both, out=both) @ ones, np.abs(x, out=x) @ ones
        out[at] = np.divide(both - apart, both + apart, out=np.zeros_like(both), where=both + apart > 0)
    return out


def _scaled(rows: np.ndarray, width: int, t: float) -> np.ndarray:
    """Projected rows, so that their product with those of another row is not negative where their similarity may reach t."""
    out = rows.copy()
    out[:, LEVELS * width : 2 * LEVELS * width] *= t
    out[:, 2 * LEVELS * width : -2] *= 1 + t
    slack = 4e-7 * rows.shape[1] - t  # more than single precision can lose
    out[:, -2], out[:, -1] = slack, rows[:, -2] * slack
    return out


def _first_floors(a: _Block, rows: np.ndarray) -> None:
    """Floors from the rows that look most similar among some of the block."""
    k, width = a.best.sims.shape[1], a.x.shape[1]
    some = np.arange(0, len(rows), -(-len(rows) // NEAR))
    if len(some) < k:
        return
    cut = slice(LEVELS * width, 2 * LEVELS * width)
    for first in range(0, len(rows), ROWS):
        mine = rows[first : first + ROWS]
        low = mine[:, : LEVELS * width] @ rows[some, : LEVELS * width].T
        high = mine[:, -2, None] + rows[some, -2] - mine[:, cut] @ rows[some, cut].T
        looks = np.divide(low, high, out=np.zeros_like(low), where=high > 0)
        near = np.argpartition(looks, len(some) - k, axis=1)[:, len(some) - k :]
        i = np.repeat(np.arange(first, first + len(mine)), k)
        sims = _exact(a, a, i, some[near.ravel()]).reshape(-1, k)
        a.floors[first : first + len(mine)] = np.maximum(a.floors[first : first + len(mine)], sims.min(axis=1))


def _meet(a: _Block, b: _Block) -> None:
    """Every row of a meets every row of b, or once every other row of a where b is a itself; both keep their best.

    With N the sum of lesser sizes, negative where signs differ, P that of all lesser sizes and S that of both norms, Jaccard is
    N / (S - P), at least t where N + t P - t S is not negative. A lesser size is the product of both sizes cut at levels,
    plus at most the product of the roots of what the levels leave; so one matrix product bounds the whole sum from above.
    What this bound leaves possible is compared exactly. Rows go by what they ask for, so that a tile has one t.
    """
    width = a.x.shape[1]
    sizes = np.concatenate([np.abs(s.x[:: -(-len(s.x) // NEAR)]).ravel() for s in (a, b)])
    top = float(np.quantile(sizes[sizes > 0], 0.9)) if sizes.any() else 1.0
    mine = a.project(top)
    if a is b:
        _first_floors(a, mine)
    i_of = np.argsort(a.least(), kind="stable")
    j_of = i_of if a is b else np.argsort(b.least(), kind="stable")
    mine, theirs = mine[i_of], None if a is b else b.project(top)[j_of]
    theirs = mine if theirs is None else theirs
    waiting: list[tuple[np.ndarray, ...]] = []
    held = 0

    def rank() -> None:
        i, j, sims = (np.concatenate(x) for x in zip(*waiting, strict=True))
        waiting.clear()
        if a is b:
            other = i != j
            i, j, sims = np.r_[i, j[other]], np.r_[j, i[other]], np.r_[sims, sims[other]]
        else:
            b.best.take(j, a.ids[i], sims)
        a.best.take(i, b.ids[j], sims)

    for first in range(0, len(a.ids), ROWS):
        rows = slice(first, first + ROWS)
        scaled: dict[float, np.ndarray] = {}
        for start in range(first if a is b else 0, len(b.ids), COLUMNS):
            columns = slice(start, start + COLUMNS)
            i, j = i_of[rows], j_of[columns]
            t = float(np.clip(min(_asked(a, i).min(), _asked(b, j).min()), -1.0, 1.0))
            if t not in scaled:
                scaled = {t: _scaled(mine[rows], width, t)}
            at = np.flatnonzero(scaled[t] @ theirs[columns].T >= 0)
            if not len(at):
                continue
            row, column = np.divmod(at, len(j))
            if a is b:
                once = row + first <= column + start
                row, column = row[once], column[once]
            i, j = i[row], j[column]
            least = np.minimum(_asked(a, i), _asked(b, j))
            near = _nearly(a, b, i, j) >= least - 1e-4
            i, j = i[near], j[near]
            sims = _exact(a, b, i, j)
            good = sims >= least[near]
            waiting.append((i[good], j[good], sims[good]))
            held += len(waiting[-1][0])
            if held > HELD:
                rank()
                held = 0
    if waiting:
        rank()


def _asked(block: _Block, rows: np.ndarray) -> np.ndarray:
    return np.maximum(block.best.sims[rows, -1], block.floors[rows])


def jaccard_knn(rows: DataFrame, k: int, *, block: int = 32_768, key: str = "id", value: str = "v") -> DataFrame:
    """(i, j, sim, rank): for every row its k best rows by continuous Jaccard, itself included, ties to the smaller j.

    rows: key bigint, value array<double> of one length. All pairs are compared, each once for both its rows; work grows
    with the square of the rows, memory with the block.
    """
    n = max(1, rows.count())
    blocks = max(-(-n // block), min(20, -(-n // 512)))
    packed = rows.groupBy(F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list(F.struct(key, value)).alias("of"))
    packed = packed.select("block", F.col(f"of.{key}").alias("ids"), F.flatten(f"of.{value}").alias("data"))

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's rows meet each other first; the k-th similarities are floors for the other blocks."""
        for batch in batches:
            for r in range(batch.num_rows):
                mine = _Block(*_unpacked(batch, r, 1), k)
                _meet(mine, mine)
                best = [pa.array([x.ravel()]) for x in (mine.best.js, mine.best.sims)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(r, 1) for c in range(3)), pa.array([mine.least()]), *best], names=["block", "ids", "data", "floors", "js", "sims"])

    def away(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, of = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                cell, side = (batch.column(c)[r].as_py() for c in range(2))
                here = _Block(*_unpacked(batch, r, 3), k, batch.column(5)[r].values.to_numpy())
                if side == 0:
                    mine, of = here, cell
                elif of == cell:
                    _meet(mine, here)
                    yield mine.best.found(mine.ids)
                    yield here.best.found(here.ids)

    alone = packed.repartition(2 * blocks, "block").mapInArrow(home, "block int, ids array<bigint>, data array<double>, floors array<double>, js array<bigint>, sims array<double>")
    alone = kept(alone, "blocks")
    own = alone.select(F.explode(F.arrays_zip("ids", F.sequence(F.lit(0), F.size("ids") - 1).alias("nth"))).alias("x"), "js", "sims")
    own = own.select(F.col("x.ids").alias("i"), F.explode(F.arrays_zip(*[F.slice(c, F.col("x.nth") * k + 1, F.lit(k)).alias(c) for c in ("js", "sims")])).alias("x"))
    own = own.select("i", F.col("x.js").alias("j"), F.col("x.sims").alias("sim")).where(F.col("sim") > -2)
    cell, part = (F.least("block", "other") * blocks + F.greatest("block", "other")).alias("cell"), (F.col("block") > F.col("other")).cast("int").alias("side")
    pairs = alone.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).where("block <> other").select(cell, part, "block", "ids", "data", "floors")
    return ranked(own.unionByName(dealt(pairs, blocks * (blocks - 1) // 2 or 1).mapInArrow(away, KNN)), k)


def _unpacked(batch: pa.RecordBatch, r: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    ids, data = (batch.column(c)[r].values.to_numpy() for c in (first, first + 1))
    return ids, data.reshape(len(ids), -1)


def fine_similarity(edges: DataFrame, features: DataFrame, *, positions: int, width: int, min_overlap: float = 0.7, rounding: Callable = int) -> DataFrame:
    """(i, j, sim): Jaccard of i's and j's features at the best offset, j forward or reversed, for the pairs of edges.

    features: id, fwd array<double>, rev array<double>. Only the pairs asked for are compared.
    Features are packed into blocks, and the pairs of two blocks meet them in one task, so features are not sent once per
    pair.
    """
    pad = rounding(positions * (1 - min_overlap))
    blocks = max(1, -(-features.count() // 2500))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    packed = features.groupBy(block("id").alias("block")).agg(F.collect_list(F.struct("id", "fwd", "rev")).alias("of"))
    packed = kept(packed.select("block", F.col("of.id").alias("ids"), F.flatten("of.fwd").alias("fwd"), F.flatten("of.rev").alias("rev")), "feature-blocks")
    packed = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    none = lambda kind, name: F.lit(None).cast(f"array<{kind}>").alias(name)
    left = packed.select((F.col("block") * blocks + F.col("other")).alias("cell"), F.lit(0).alias("side"), "block", "ids", none("bigint", "js"), "fwd", none("double", "rev"))
    right = packed.select((F.col("other") * blocks + F.col("block")).alias("cell"), F.lit(1).alias("side"), "block", "ids", none("bigint", "js"), "fwd", "rev")
    asked = edges.select((block("i") * blocks + block("j")).alias("cell"), F.pmod(F.xxhash64("i", "j"), F.lit(8)).cast("int").alias("block"), F.struct("i", "j").alias("pair"))
    asked = asked.groupBy("cell", "block").agg(F.collect_list("pair").alias("of"))
    asked = asked.select("cell", F.lit(2).alias("side"), "block", F.col("of.i").alias("ids"), F.col("of.j").alias("js"), none("double", "fwd"), none("double", "rev"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, ...]] = {}
        of = None
        for batch in batches:
            for r in range(batch.num_rows):
                cell, side = (batch.column(c)[r].as_py() for c in range(2))
                held, of = ({} if cell != of else held), cell
                ids = batch.column(3)[r].values.to_numpy()
                if side < 2:
                    order = np.argsort(ids, kind="stable")
                    rows = [batch.column(c)[r].values.to_numpy().reshape(len(ids), -1)[order] for c in (5, 6)[: side + 1]]
                    held[side] = (ids[order], *rows)
                elif len(held) == 2:
                    js = batch.column(4)[r].values.to_numpy()
                    known = np.isin(ids, held[0][0]) & np.isin(js, held[1][0])
                    ids, js = ids[known], js[known]
                    for first in range(0, len(ids), PAIRS):
                        i, j = ids[first : first + PAIRS], js[first : first + PAIRS]
                        y, at = held[0][1][np.searchsorted(held[0][0], i)], np.searchsorted(held[1][0], j)
                        sim = np.maximum(jaccard_pairs(held[1][1][at], y, pad, width)[0], jaccard_pairs(held[1][2][at], y, pad, width)[0])
                        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(sim)], names=["i", "j", "sim"])

    return dealt(left.unionByName(right).unionByName(asked), blocks * blocks).mapInArrow(compare, KNN)


def rank_correlation(rows: DataFrame, *, by: str = "i", x: str = "x", y: str = "y") -> DataFrame:
    """(by, rho): Spearman per group with average ranks; null where it is undefined."""

    def ranks(c: str):
        w = Window.partitionBy(by)
        return F.rank().over(w.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(by, c)) - 1) / 2

    ranked = rows.select(by, ranks(x).alias("rx"), ranks(y).alias("ry"))
    n, sx, sy = F.count(F.lit(1)), F.sum("rx"), F.sum("ry")
    cov = F.sum(F.col("rx") * F.col("ry")) - sx * sy / n
    vx, vy = F.sum(F.col("rx") * F.col("rx")) - sx * sx / n, F.sum(F.col("ry") * F.col("ry")) - sy * sy / n
    return ranked.groupBy(by).agg(F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * vy)).alias("rho"))


def correlation_filter(coarse: DataFrame, fine: DataFrame, threshold: float) -> DataFrame:
    """Ids whose fine and coarse similarities agree in rank by more than the threshold, over pairs with fine != 0."""
    both = fine.where(F.abs("sim") > 0).select("i", "j", F.col("sim").alias("x")).join(coarse.select("i", "j", F.col("sim").alias("y")), ["i", "j"])
    return rank_correlation(both).where(F.col("rho") > threshold).select(F.col("i").alias("id"))


def auroc(rows: DataFrame, *, by: tuple[str, ...], label: str = "label", score: str = "score") -> DataFrame:
    """(by, auroc): the chance that a positive scores above a negative, by average ranks; 0.5 with one class only."""
    w = Window.partitionBy(*by)
    rank = F.rank().over(w.orderBy(score)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, score)) - 1) / 2
    ranked = rows.withColumn("_r", rank).groupBy(*by).agg(F.sum(F.when(F.col(label) == 1, F.col("_r"))).alias("s"), F.count_if(F.col(label) == 1).cast("double").alias("p"), F.count_if(F.col(label) != 1).cast("double").alias("n"))
    value = (F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("n"))
    return ranked.select(*by, F.when((F.col("p") > 0) & (F.col("n") > 0), value).otherwise(F.lit(0.5)).alias("auroc"))
