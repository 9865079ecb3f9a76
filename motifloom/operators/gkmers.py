"""Gapped k-mers of seqlets and the coarse neighbours they give."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import kept
from .similarity import Best, dealt, ranked

GKMERS = "id bigint, gkmer bigint, value double, nth int"


@lru_cache(maxsize=16)
def subsets(n: int, k: int) -> np.ndarray:
    """All k-subsets of 0..n-1, by first, then last, then the members between."""
    found = np.array(list(itertools.combinations(range(n), k)), dtype=np.int64).reshape(-1, k)
    return found[np.lexsort([*(found[:, c] for c in range(k - 2, 0, -1)), found[:, -1], found[:, 0]])]


def gapped_kmers(letters: np.ndarray, importance: np.ndarray, *, topn: int = 20, min_k: int = 4, max_k: int = 6, max_gap: int = 15, max_len: int = 15, max_entries: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, values), best first: gapped k-mers over the most important positions.

    A k-mer's hash is the sum of (letter + 1) * 5^offset from its first member, its value the mean importance of its
    members; equal k-mers add up. The max_entries largest absolute values stay, ties by first occurrence (short ones
    first); zeros go.
    """
    keep = np.sort(np.lexsort((np.arange(len(letters)), -importance))[:topn])
    hashes, values = [], []
    for k in range(min_k, min(max_k, len(keep)) + 1):
        pos = keep[subsets(len(keep), k)]
        fits = (pos[:, -1] - pos[:, 0] < max_len) & (np.diff(pos, axis=1) <= max_gap).all(axis=1)
        pos = pos[fits]
        hashes.append(((letters[pos] + 1) * 5 ** (pos - pos[:, :1])).sum(axis=1))
        values.append(importance[pos].sum(axis=1) / k)
    if not hashes:
        return np.zeros(0, np.int64), np.zeros(0)
    names, first, at = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    total = np.bincount(at, weights=np.concatenate(values), minlength=len(names))
    order = np.lexsort((first, -np.abs(total)))
    order = order[total[order] != 0][:max_entries]
    return names[order], total[order]


def seqlet_gkmers(seqlets: DataFrame, *, sign: int = 1, forward: bool = True, **options) -> DataFrame:
    """(id, gkmer, value, nth) from rows (id, letters array<int>, importance array<double>), in Arrow batches."""

    def extract(batches):
        for batch in batches:
            out = []
            for key, letters, importance in zip(batch["id"], batch["letters"], batch["importance"], strict=True):
                letters, importance = np.asarray(letters, dtype=np.int64), np.asarray(importance, dtype=np.float64) * sign
                if not forward:
                    letters, importance = 3 - letters[::-1], importance[::-1]
                names, values = gapped_kmers(letters, importance, **options)
                out.append(pd.DataFrame({"id": key, "gkmer": names, "value": values, "nth": np.arange(len(names))}))
            yield pd.concat(out) if out else pd.DataFrame({"id": [], "gkmer": [], "value": [], "nth": []})

    return seqlets.select("id", "letters", "importance").mapInPandas(extract, GKMERS)


PRODUCTS = 2_000_000  # products of two postings that are added up at once
HELD = 4_000_000  # partial sums that a task holds before it hands them on


def _products(frame: pd.DataFrame) -> Iterator[tuple[np.ndarray, ...]]:
    """(i, j, strand, product) of all postings of whole lists, a bounded number at a time."""
    key = frame.groupby(["gkmer", "a", "b"], sort=False).ngroup().to_numpy()
    side, ids, values = (frame[c].to_numpy() for c in ("side", "id", "value"))
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side > 0)
    right = right[np.argsort(key[right], kind="stable")]
    low, high = (np.searchsorted(key[right], key[left], where) for where in ("left", "right"))
    hits = high - low
    first = 0
    while first < len(left):
        ends = np.cumsum(hits[first:])
        last = first + max(1, int(np.searchsorted(ends, PRODUCTS, "right")))
        n = hits[first:last]
        at = right[np.repeat(low[first:last] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        mine = np.repeat(left[first:last], n)
        yield ids[mine], ids[at], side[at] - 1, values[mine] * values[at]
        first = last


def _summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    i, j, strand, value = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((strand, j, i))
    i, j, strand, value = i[order], j[order], strand[order], value[order]
    head = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (j[1:] != j[:-1]) | (strand[1:] != strand[:-1])]) if len(i) else np.zeros(0, np.int64)
    return i[head], j[head], strand[head], np.add.reduceat(value, head) if len(head) else value


def _partial_sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of products by (i, j, strand) over the lists of a task, one row per i with all its j."""
    held, size, rest = [], 0, None

    def handed():
        i, j, strand, value = _summed(held)
        at = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, np.int64)
        cut = lambda x: np.split(x, at[1:]) if len(at) else []
        return pd.DataFrame({"i": i[at], "js": cut(j), "strands": cut(strand.astype(np.int8)), "sums": cut(value)})

    for frame in chain(frames, [None]):
        whole = rest if frame is None else frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        if whole is None or not len(whole):
            continue
        if frame is not None:  # the last list may go on in the next frame
            last = whole[["gkmer", "a", "b"]].iloc[-1]
            open_ = ((whole[["gkmer", "a", "b"]] == last).all(axis=1)).to_numpy()
            whole, rest = whole[~open_], whole[open_]
        for part in _products(whole):
            held.append(part)
            size += len(part[0])
            if size > HELD:
                held = [_summed(held)]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield handed()
                    held, size = [], 0
    if held:
        yield handed()


TILE = 250_000  # similarities, or products to add up, that are held at once; they stay in the processor's cache


def _packed(forward: DataFrame, reverse: DataFrame, ids: DataFrame, blocks: int) -> DataFrame:
    """One row per block of ids: ids in order and, for both strands, the postings by k-mer: place of the id, k-mer, value over
    the length of the id's values. Postings of other ids are left out."""
    rows = ids.select("id", F.lit(0).alias("side"), F.lit(None).cast("bigint").alias("gkmer"), F.lit(None).cast("double").alias("value"))
    for side, postings in enumerate((forward, reverse), 1):
        rows = rows.unionByName(postings.select("id", F.lit(side).alias("side"), "gkmer", "value"))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        side = frame["side"].to_numpy()
        names = np.unique(frame["id"].to_numpy()[side == 0])
        out = {"block": [frame["block"].iloc[0]], "ids": [names]}
        for nth, name in enumerate(("forward", "reverse"), 1):
            mine = frame[(side == nth) & frame["id"].isin(names)]
            at, value = np.searchsorted(names, mine["id"].to_numpy()), mine["value"].to_numpy()
            size = np.sqrt(np.bincount(at, weights=value * value, minlength=len(names)))[at]
            order = np.argsort(mine["gkmer"].to_numpy(), kind="stable")
            out |= {f"{name}_at": [at[order]], f"{name}_gkmers": [mine["gkmer"].to_numpy(np.int64)[order]], f"{name}_values": [np.divide(value, size, out=np.zeros(len(value)), where=size > 0)[order]]}
        return pd.DataFrame(out)

    strands = ", ".join(f"{name}_at array<int>, {name}_gkmers array<bigint>, {name}_values array<double>" for name in ("forward", "reverse"))
    named = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    return kept(named.groupBy("block").applyInPandas(pack, f"block int, ids array<bigint>, {strands}"), "kmer-blocks")


class _Asking:
    """Rows that look for their k best among blocks that come by."""

    def __init__(self, parts: list[tuple[np.ndarray, ...]], k: int):
        self.ids = np.concatenate([p[0] for p in parts])
        first = np.cumsum([0, *(len(p[0]) for p in parts)])
        at = np.concatenate([p[1] + n for p, n in zip(parts, first[:-1], strict=True)])
        order = np.argsort(at, kind="stable")
        self.at, self.values = at[order], np.concatenate([p[3] for p in parts])[order]
        self.names, self.codes = np.unique(np.concatenate([p[2] for p in parts])[order], return_inverse=True)
        self.start = np.searchsorted(self.at, np.arange(len(self.ids) + 1))
        self.best = Best(len(self.ids), k)

    def meet(self, ids: np.ndarray, strands: list[tuple[np.ndarray, ...]]) -> None:
        n = len(ids)
        gkmers = np.concatenate([s[1] for s in strands])
        order = np.argsort(gkmers, kind="stable")
        gkmers, values = gkmers[order], np.concatenate([s[2] for s in strands])[order]
        cell = np.concatenate([s[0].astype(np.int64) + k * n for k, s in enumerate(strands)])[order]
        low, high = (np.searchsorted(gkmers, self.names, side)[self.codes] for side in ("left", "right"))
        hits = high - low
        ends = np.r_[0, np.cumsum(hits)][self.start]  # products before each row
        first = 0
        while first < len(self.ids):
            last = min(first + max(1, TILE // (2 * n)), max(first + 1, int(np.searchsorted(ends, ends[first] + TILE, "right")) - 1))
            mine = slice(self.start[first], self.start[last])
            many = hits[mine]
            right = np.repeat(low[mine] - (np.cumsum(many) - many), many) + np.arange(ends[last] - ends[first])
            cells = np.repeat((self.at[mine] - first) * (2 * n), many) + cell[right]
            sums = np.bincount(cells, weights=np.repeat(self.values[mine], many) * values[right], minlength=(last - first) * 2 * n).reshape(-1, 2 * n)
            least = self.best.sims[first:last, -1]
            known = least > 0  # who has k positive ones already looks for better ones only
            near = np.flatnonzero(sums >= np.where(known, least - 1e-11, np.inf)[:, None])
            if len(near):
                i, j = np.divmod(np.unique(near // (2 * n) * n + near % n), n)
                self.best.take(i + first, ids[j], np.round(np.maximum(sums[i, j], sums[i, n + j]), 12))
            if not known.all():
                self._meet_all(first + np.flatnonzero(~known), ids, sums.reshape(-1, 2, n)[~known])
            first = last

    def _meet_all(self, rows: np.ndarray, ids: np.ndarray, sums: np.ndarray) -> None:
        """Rows meet all ids of a block, also those without a common k-mer."""
        sims = np.maximum(sums[:, 0], sums[:, 1])
        least, k = self.best.sims[rows, -1:], self.best.sims.shape[1]
        if len(ids) > k and not np.isfinite(least).all():
            size = max(1, len(ids) // (8 * k))  # the k-th best of the best of so many ids each is reached by k of them
            tops = sims[:, : len(ids) // size * size].reshape(len(rows), -1, size).max(axis=2)
            least = np.maximum(least, np.partition(tops, -k, axis=1)[:, -k, None])
        i, j = np.nonzero(sims >= least - 1e-11)
        self.best.take(rows[i], ids[j], np.round(sims[i, j], 12))


def coarse_knn(forward: DataFrame, reverse: DataFrame, ids: DataFrame, k: int, *, chunk: int = 2048) -> DataFrame:
    """(i, j, sim, rank): for every id its k best by the larger cosine of forward with forward or reverse k-mers.

    Pairs without a common k-mer have similarity 0 and rank by id, before negative ones; an id is its own neighbour.

    Ids are packed into blocks of at most `chunk` with their postings. A task holds some blocks that ask and lets the blocks
    of its share come by, one at a time; products of common k-mers are added up for a tile of pairs, of which only the k
    best per id stay. So no sums of pairs are written; what is shuffled is each block to a bounded number of tasks, until
    a task has 64 blocks that ask, and k rows per id and share.
    """
    n = max(1, ids.count())
    blocks = max(-(-n // chunk), min(24, -(-n // 64)))
    packed = _packed(forward, reverse, ids, blocks)
    asking, shares = max(min(blocks, 8), -(-blocks // 64)), min(blocks, 6)
    names = [f"{s}_{c}" for s in ("forward", "reverse") for c in ("at", "gkmers", "values")]
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = packed.withColumn("share", every(shares)).select((F.col("block") % asking * shares + F.col("share")).alias("cell"), F.lit(0).alias("side"), "block", "ids", *names[:3], *[F.lit(None).cast(packed.schema[c].dataType).alias(c) for c in names[3:]])
    right = packed.withColumn("asking", every(asking)).select((F.col("asking") * shares + F.col("block") % shares).alias("cell"), F.lit(1).alias("side"), "block", "ids", *names)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, asks, of = [], None, None
        for batch in batches:
            for r in range(batch.num_rows):
                cell, side = (batch.column(c)[r].as_py() for c in range(2))
                if cell != of:
                    if asks:
                        yield asks.best.found(asks.ids)
                    parts, asks, of = [], None, cell
                row = [batch.column(c)[r].values.to_numpy() for c in range(3, 7 if side == 0 else 10)]
                if side == 0:
                    parts.append(tuple(row))
                elif parts:
                    asks = asks or _Asking(parts, k)
                    asks.meet(row[0], [tuple(row[1:4]), tuple(row[4:7])])
        if asks:
            yield asks.best.found(asks.ids)

    return ranked(dealt(left.unionByName(right), asking * shares).mapInArrow(best, "i bigint, j bigint, sim double"), k)
