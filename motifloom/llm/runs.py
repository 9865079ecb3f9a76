"""Periodic runs of words by the runs theorem.

A run is a stretch with a smallest period that no neighbouring word extends. Every run shows, in one of the two
alphabetical orders, the longest Lyndon word of one of its positions as its root. So the steps are: suffix array of the
words, its inverse, the next smaller (and, for the reversed order, next greater) value of the inverse as the end of the
longest Lyndon word of each position, and extension of each root to both sides by the longest common prefix of two
suffixes, which a sparse table of minima over the LCP array answers.

The end of a text counts as smaller than any word in the first order. The second order is the exact reverse of the suffix
array, so one array serves both: a run that ends with its text shows its root in the first order.

Several texts of a batch are handled as one string. Their words get numbers of their own, text by text, so that no suffix
of one text compares with another's and nothing is found across texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import body, tidy

BLOCK = 32  # entries of the LCP array under one entry of the sparse table
TOGETHER = 400_000  # words of the texts that are handled as one string; a longer text is handled alone
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = pa.schema([("id", pa.int64()), ("words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])


def suffix_array(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, inverse) by doubling, where each round sorts only the suffixes that are not yet alone.

    No suffix may be a prefix of another, which an end mark of its own behind each text ensures.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable").astype(np.int32)
    heads = np.r_[True, codes[order[1:]] != codes[order[:-1]]]
    place = np.arange(n, dtype=np.int32)
    group = np.maximum.accumulate(np.where(heads, place, 0)).astype(np.int32)
    rank = np.empty(n, dtype=np.int32)
    rank[order] = group
    alone = heads & np.r_[heads[1:], True]
    left = order[~alone]
    step = 1
    while len(left):
        keys = rank[left].astype(np.int64) * n + rank[left + step]
        by = np.argsort(keys, kind="stable")
        keys, left = keys[by], left[by]
        old = rank[left]
        nth = np.arange(len(left))
        heads = np.r_[True, keys[1:] != keys[:-1]]
        groups = np.r_[True, old[1:] != old[:-1]]
        rank[left] = old + np.maximum.accumulate(np.where(heads, nth, 0)) - np.maximum.accumulate(np.where(groups, nth, 0))
        left = left[~(heads & np.r_[heads[1:], True])]
        step *= 2
    array = np.empty(n, dtype=np.int32)
    array[rank] = place
    return array, rank


def matching(codes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words from a[k] and b[k] on are equal, by comparing windows; two different places always differ somewhere."""
    found = np.zeros(len(a), dtype=np.int64)
    left = np.arange(len(a))
    width = 4
    while len(left):
        at = np.arange(width)
        x, y = (codes.take((s[left] + found[left])[:, None] + at, mode="clip") for s in (a, b))
        differs = x != y
        first = differs.argmax(axis=1)
        stop = differs[np.arange(len(left)), first]
        found[left] += np.where(stop, first, width)
        left = left[~stop]
        width = int(min(max(8, 65_536 // max(1, len(left))), 16_384))
    return found


def lcp_array(codes: np.ndarray, array: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with its forerunner in the suffix array; 0 for the first.

    Where the words ahead of both suffixes are equal too, the value is one less than that of the position before; only
    the others are compared, and these sum to O(n log n) words.
    """
    n = len(codes)
    ahead = np.empty(n, dtype=np.int32)
    ahead[array[1:]] = array[:-1]
    ahead[array[0]] = -1
    place = np.arange(n, dtype=np.int32)
    fresh = (place == 0) | (ahead <= 0)
    fresh[1:] |= codes[:-1] != codes[np.maximum(ahead[1:], 1) - 1]
    at = np.flatnonzero(fresh & (ahead >= 0))
    value = np.zeros(n, dtype=np.int64)
    value[at] = matching(codes, at, ahead[at])
    last = np.maximum.accumulate(np.where(fresh, place, 0))
    by_place = value[last] - (place - last)
    return by_place[array].astype(np.int32)


class Prefixes:
    """Longest common prefix of any two suffixes: minima of the LCP array, in blocks under a sparse table."""

    def __init__(self, rank: np.ndarray, lcp: np.ndarray):
        self.rank, n = rank, len(lcp)
        rows = -(-n // BLOCK)
        most = np.iinfo(np.int32).max
        grid = np.full(rows * BLOCK, most, dtype=np.int32)
        grid[:n] = lcp
        grid = grid.reshape(rows, BLOCK)
        self.values = grid.ravel()
        self.ahead = np.minimum.accumulate(grid, axis=1).ravel()  # of the block up to here
        self.behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()  # from here to the block's end
        self.table = [grid.min(axis=1)]
        while 2 << (len(self.table) - 1) <= rows:
            below, reach = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(below[:-reach], below[reach:]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For i != j, element by element."""
        x, y = self.rank[i], self.rank[j]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y)
        first, last = low // BLOCK, high // BLOCK
        found = np.minimum(self.behind[low], self.ahead[high])
        inside = np.flatnonzero(first == last)
        for part in np.array_split(inside, max(1, len(inside) // 50_000)):
            at = low[part][:, None] + np.arange(BLOCK)
            window = self.values.take(at, mode="clip")
            found[part] = np.where(at <= high[part][:, None], window, np.iinfo(np.int32).max).min(axis=1)
        wide = np.flatnonzero(last - first > 1)
        if len(wide):
            a, b = first[wide] + 1, last[wide]  # whole blocks a to b - 1
            level = np.frexp((b - a).astype(np.float64))[1] - 1
            for k in np.unique(level):
                at = level == k
                t = self.table[k]
                found[wide[at]] = np.minimum(found[wide[at]], np.minimum(t[a[at]], t[b[at] - (1 << k)]))
        return found


def next_smaller(values: np.ndarray) -> np.ndarray:
    """Place of the next smaller value for each place, len(values) where there is none; values are not negative.

    A pointer may jump over all that its goal has jumped over, as those values are larger still. The few that a handful of
    jumps does not bring home climb a tree of minima to the first block with a smaller value and go down in it.
    """
    n = len(values)
    padded = np.append(values, -1)
    goal = np.arange(1, n + 2, dtype=np.int32)
    goal[n] = n
    left = np.flatnonzero(padded[goal[:n]] > values)
    for _ in range(6):
        goal[left] = goal[goal[left]]
        left = left[padded[goal[left]] > values[left]]
    if len(left):
        goal[left] = _climbed(padded, goal[left], values[left])
    return goal[:n]


def _climbed(values: np.ndarray, start: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """The first place from start[k] on whose value is below bound[k]; the last value is below all bounds."""
    depth = int(len(values) - 1).bit_length()
    tree = [np.append(values, np.full((1 << depth) - len(values), -1, dtype=values.dtype))]
    for _ in range(depth):
        tree.append(np.minimum(tree[-1][::2], tree[-1][1::2]))
    block, level = start.astype(np.int64), np.full(len(start), -1)
    left = np.arange(len(start))
    for k in range(depth + 1):  # a block that starts its parent is left to the parent
        at = block[left]
        odd = (at & 1 == 1) | (k == depth)
        hit = odd & (tree[k][at] < bound[left])
        level[left[hit]] = k
        block[left[~hit]] = (at[~hit] + odd[~hit]) >> 1
        left = left[~hit]
    for k in range(depth, 0, -1):
        down = np.flatnonzero(level == k)
        first = block[down] * 2
        block[down] = first + (tree[k - 1][first] >= bound[down])
        level[down] = k - 1
    return block


def runs_of(codes: np.ndarray, least_words: int, least_exponent: int) -> np.ndarray:
    """Rows (start, length, period) of all runs of a string of codes, sorted; exponents of at least 2.

    Every text in the string must end with a code that occurs nowhere else, the codes of a text must be smaller than
    those of the texts behind it, and its end mark smaller than its words.
    """
    none = np.zeros((0, 3), dtype=np.int64)
    if len(codes) < 2:
        return none
    array, rank = suffix_array(codes)
    roots = []
    for values in (rank, len(rank) - 1 - rank):
        goal = next_smaller(values)
        at = np.flatnonzero(goal < len(codes))
        at = at[codes[at] == codes[goal[at]]]  # the word behind a root that repeats is its first
        roots.append(np.stack([at, goal[at]]))
    i, k = np.unique(np.concatenate(roots, axis=1), axis=1)
    if not len(i):
        return none
    prefix = Prefixes(rank, lcp_array(codes, array, rank))
    period = (k - i).astype(np.int64)
    right = prefix(i, k).astype(np.int64)
    # the first root of a run lies within its first period, and so has all the rest of the run behind it
    most = 2 * period - 1 + right
    good = (right >= (least_exponent - 2) * period + 1) & (most >= least_exponent * period) & (most >= least_words)
    i, period, right = i[good].astype(np.int64), period[good], right[good]
    # to the left: the smallest start from which the period reaches i; a whole period to the left lies the same root again
    low, high = np.maximum(i - period, 0), i.copy()
    while (low < high).any():
        middle = (low + high) // 2
        reaches = prefix(middle, middle + period) >= i - middle
        low, high = np.where(reaches | (low >= high), low, middle + 1), np.where(reaches & (low < high), middle, high)
    rows = np.stack([low, i + period + right - low, period], axis=1)[low > i - period]
    rows = rows[(rows[:, 1] >= least_words) & (rows[:, 1] >= least_exponent * rows[:, 2])]
    return np.unique(rows, axis=0) if len(rows) else none


def _numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, starts): all texts as one string, each followed by its end mark."""
    known: dict[bytes, int] = {}
    sizes = np.array([len(words) for words in texts])
    starts = np.r_[0, np.cumsum(sizes + 1)]
    codes = np.empty(starts[-1], dtype=np.int64)
    for words, start in zip(texts, starts[:-1], strict=True):
        codes[start : start + len(words)] = [known.setdefault(w, len(known) + 1) for w in words]
        codes[start + len(words)] = 0
    text = np.repeat(np.arange(len(texts)), sizes + 1)
    return codes + text * (len(known) + 1), starts


def _found(texts: list[list[bytes]], least_words: int, least_exponent: int) -> list[np.ndarray]:
    codes, starts = _numbered(texts)
    rows = runs_of(codes, least_words, least_exponent)
    cut = np.searchsorted(rows[:, 0], starts)
    return [rows[a:b] - [start, 0, 0] for a, b, start in zip(cut[:-1], cut[1:], starts[:-1], strict=True)]


def collapsed_words(words: list[bytes], rows: np.ndarray) -> list[bytes]:
    """Without the words that a run holds after its first period."""
    if not len(rows):
        return words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, rows[:, 0] + rows[:, 2], 1)
    np.add.at(change, rows[:, 0] + rows[:, 1], -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def periodic_runs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least_words: int = 24, least_exponent: int = 3) -> DataFrame:
    """All periodic runs of each text, and the text with every run cut to its first period.

    Returns doc_id, words (how many), runs (array of start, length, period by start, then period) and collapsed (the kept
    words, joined by one space), one row per input row, so rows that repeat give the same row again. Words are separated
    by ASCII white space. A run has at least `least_words` words and `least_exponent` (2 or more) periods. Null and empty
    texts have no words, no runs and an empty collapsed text; a null id stays null; other columns are ignored, whatever
    their names; an empty table gives an empty one. A text is never cut: memory grows in proportion to its words (about
    100 bytes each beside the words themselves), time as n log n.
    """
    if least_exponent < 2:
        raise ValueError("runs have at least two periods")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            start = 0
            while start < len(ids):
                words, total = [], 0
                while start + len(words) < len(ids) and (not words or total < TOGETHER):
                    words.append(texts[start + len(words)].as_py().encode().split())  # bytes split at ASCII white space
                    total += len(words[-1])
                yield part(ids[start : start + len(words)], words)
                start += len(words)

    def part(ids: list, words: list[list[bytes]]) -> pa.RecordBatch:
        long = [k for k, w in enumerate(words) if len(w) >= max(least_words, least_exponent)]
        rows = dict(zip(long, _found([words[k] for k in long], least_words, least_exponent), strict=True)) if long else {}
        none = np.zeros((0, 3), dtype=np.int64)
        rows = [rows.get(k, none) for k in range(len(words))]
        flat = np.concatenate([none, *rows])
        offsets = pa.array(np.r_[0, np.cumsum([len(r) for r in rows])], pa.int32())
        runs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], fields=list(_RUN)))
        kept = [b" ".join(collapsed_words(w, r)).decode() for w, r in zip(words, rows, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(w) for w in words], pa.int64()), runs, pa.array(kept, pa.string())], schema=_SCHEMA)

    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), body(text).alias("body"))
    found = rows.mapInArrow(tidy(run), f"id bigint, words bigint, runs {RUNS}, collapsed string")
    return found.withColumnRenamed("id", doc_id)
