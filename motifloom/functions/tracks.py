"""Column builders over per-position tracks.

A matrix is an array of positions, each an array of four base values in the order A, C, G, T; letters are base numbers
0-3. All builders are plain expressions, so they run inside the JVM on one row per example, seqlet or pattern.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = "ACGT"


def total(values: Column, of=lambda x: x) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + of(x).cast("double"))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: a lambda would compute what it captures again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def contributions(letters: Column, hyp: Column) -> Column:
    """The hypothetical values at the letters, zero elsewhere."""
    return F.zip_with(letters, hyp, lambda b, row: F.transform(row, lambda x, i: F.when(i == b, x).otherwise(F.lit(0).cast("double"))))


def attribution(matrix: Column) -> Column:
    """Sum over bases, per position."""
    return F.transform(matrix, lambda row: total(row))


def best_letter(row: Column) -> Column:
    """Index of the largest value, the first on ties."""
    return (F.array_position(row, F.array_max(row)) - 1).cast("int")


def letters_text(letters: Column) -> Column:
    return F.array_join(F.transform(letters, lambda b: F.substring(F.lit(ALPHABET), b + 1, F.lit(1))), "")


def revcomp_letters(letters: Column) -> Column:
    return F.reverse(F.transform(letters, lambda b: 3 - b))


def revcomp_matrix(matrix: Column) -> Column:
    return F.reverse(F.transform(matrix, lambda row: F.reverse(row)))


def centre_crop(values: Column, window: int) -> Column:
    """The window around the middle; odd windows give one column less."""
    half = window // 2
    return F.slice(values, F.floor(F.size(values) / 2).cast("int") - half + 1, 2 * half)


def window_slice(values: Column, start: Column, stop: Column, is_revcomp: Column, matrix: bool) -> Column:
    """Positions start to stop of a track, on the strand asked for."""
    part = F.slice(values, start + 1, stop - start)
    return F.when(is_revcomp, revcomp_matrix(part) if matrix else revcomp_letters(part)).otherwise(part)


def l1_normalise(values: Column) -> Column:
    return let(total(values, F.abs), lambda size: F.transform(values, lambda x: F.when(size == 0, F.lit(0.0)).otherwise(x / size)))


def magnitude(values: Column) -> Column:
    """Centred and scaled to length one."""
    centred = let(total(values) / F.size(values), lambda mean: F.transform(values, lambda x: x - mean))
    return let(centred, lambda v: let(F.sqrt(total(v, lambda x: x * x)) + 1e-7, lambda size: F.transform(v, lambda x: x / size)))


def softmax(row: Column) -> Column:
    powers = let(F.array_max(row), lambda top: F.transform(row, lambda x: F.exp(x - top)))
    return let(powers, row_share)


def row_share(row: Column) -> Column:
    return let(total(row), lambda size: F.transform(row, lambda x: F.when(size == 0, F.lit(0.0)).otherwise(x / size)))


def jaccard(a: Column, b: Column) -> Column:
    """Continuous Jaccard of two flat arrays; 0 where both are empty of signal."""
    low = total(F.zip_with(a, b, lambda x, y: F.signum(x) * F.signum(y) * F.least(F.abs(x), F.abs(y))))
    high = total(F.zip_with(a, b, lambda x, y: F.greatest(F.abs(x), F.abs(y))))
    return F.when(high == 0, F.lit(0.0)).otherwise(low / high)


def cosine(a: Column, b: Column) -> Column:
    dot, norm = total(F.zip_with(a, b, lambda x, y: x * y)), F.sqrt(total(a, lambda x: x * x) * total(b, lambda x: x * x))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot / norm)


def at_offsets(x: Column, y: Column, pad: int, width: int, score) -> Column:
    """score(x, y shifted) for shifts -pad..pad of flat arrays with `width` values per position; y is padded with zeros.

    Returns an array of structs (score, offset), offset in positions of y.
    """
    zeros = F.array_repeat(F.lit(0.0), pad * width)
    padded = F.concat(zeros, F.transform(y, lambda v: v.cast("double")), zeros)
    return F.transform(F.sequence(F.lit(0), F.lit(2 * pad)), lambda o: F.struct(score(x, F.slice(padded, o * width + 1, F.size(x))).alias("score"), (o - pad).alias("offset")))


def best_offset(scored: Column) -> Column:
    """The best (score, offset), the first offset on ties."""
    return F.reduce(scored, F.element_at(scored, 1), lambda a, x: F.when(x["score"] > a["score"], x).otherwise(a))


def position_ic(row: Column, background: Column, pseudocount: float = 0.001) -> Column:
    """Information content of one position against the background."""

    def term(p: Column, q: Column) -> Column:
        return p * F.log2((p + pseudocount) / (1 + 4 * pseudocount)) - q * F.log2(q)

    return total(F.zip_with(row, background, term))


def sliding_sums(values: Column, window: int) -> Column:
    """Sums of all whole windows."""
    last = F.size(values) - window
    sums = F.transform(F.sequence(F.lit(1), last + 1), lambda i: total(F.slice(values, i, window)))
    return F.when(last < 0, F.array().cast("array<double>")).otherwise(sums)


def pick_peaks(scores: Column, flank: int, suppress: int) -> Column:
    """Greedy picks from an array of scores (null: masked), best first, lowest position on ties.

    The unmasked positions are sorted once; each is picked unless an earlier pick lies within `suppress` of it. A pick
    too close to an end for its flank keeps others away but does not count. Returns an array of structs (pos, score).
    """

    def step(picks: Column, c: Column) -> Column:
        near = F.exists(picks, lambda p: F.abs(p["pos"] - c["pos"]) <= suppress)
        return F.when(near, picks).otherwise(F.concat(picks, F.array(F.struct(c["pos"].alias("pos"), c["score"].alias("score")))))

    def greedy(s: Column) -> Column:
        found = F.transform(s, lambda x, i: F.struct((-x.cast("double")).alias("worse"), i.alias("pos"), x.cast("double").alias("score")))
        order = F.array_sort(F.filter(found, lambda c: c["score"].isNotNull()))
        picks = F.aggregate(order, F.array().cast("array<struct<pos:int,score:double>>"), step)
        return let(F.size(s), lambda n: F.filter(picks, lambda p: (p["pos"] >= flank) & (p["pos"] < n - flank)))

    return let(scores, greedy)


def sim_to_distance(sim: Column) -> Column:
    return F.greatest(F.log(2 / F.greatest(sim, F.lit(1e-7)) - 1), F.lit(0.0))


def perplexity_beta(distances: Column, perplexity: float, steps: int = 100, tolerance: float = 1e-5) -> Column:
    """The precision at which 1 + exp(-distance * beta), normalised, has the given perplexity; by bisection."""
    import math

    goal = math.log(perplexity)
    none = F.lit(None).cast("double")
    state = F.struct(F.lit(1.0).alias("b"), none.alias("lo"), none.alias("hi"), F.lit(False).alias("done"))

    def step(s: Column, _: Column) -> Column:
        b = s["b"]
        z = 1 + total(distances, lambda d: F.exp(-d * b))
        entropy = F.log(z) + b * total(distances, lambda d: d * F.exp(-d * b)) / z
        off = entropy - goal
        up = F.struct(F.when(s["hi"].isNull(), b * 2).otherwise((b + s["hi"]) / 2).alias("b"), b.alias("lo"), s["hi"].alias("hi"), F.lit(False).alias("done"))
        down = F.struct(F.when(s["lo"].isNull(), b / 2).otherwise((b + s["lo"]) / 2).alias("b"), s["lo"].alias("lo"), b.alias("hi"), F.lit(False).alias("done"))
        stay = F.struct(b.alias("b"), s["lo"].alias("lo"), s["hi"].alias("hi"), F.lit(True).alias("done"))
        return F.when(s["done"] | (F.abs(off) < tolerance), stay).when(off > 0, up).otherwise(down)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, step)["b"]
