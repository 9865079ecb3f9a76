"""Exact top-k search by inner product over an impact-ordered, score-at-a-time index.

Vectors are dealt into shards. A shard's index holds, for each dimension, its postings (place of the vector, value) sorted by
descending quantised impact, the number of bits of the absolute value. Postings of one dimension and impact are a segment,
and segments are taken in descending impact, each by the queries that have a weight in its dimension, into one accumulator
per vector and query; the many postings of a low impact are laid out as a tile, which costs less than to take them singly. What the segments still to come can change in a score is at most the query's length times the length
of what is left of the vector. After each impact a query stops as soon as the vectors that this leaves possible cost less
to rescore than the rest of the postings, and these are rescored exactly; the others are proven out. So results are exact
in any case.

Each query first searches one shard. The k-th score found there is a floor for the others, where most queries then stop
early and hand on only what reaches the floor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

ROWS = "shard bigint, dims int, block bigint, ids array<bigint>, floors array<bigint>, data array<bigint>"
HITS = "query_id bigint, vec_id bigint, score bigint"
_HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
TAKEN = -(2.0**60)  # the accumulator of a vector that takes no part
NO_FLOOR = -(2**62)
SPARSE = 64  # an impact is taken by segments where at most one value in so many belongs to it


class ShardIndex:
    """The impact-ordered index of one shard: ids int64 [n] and integer vectors [n, d]. `taken` counts the postings that
    queries have taken, `rescored` the values read to rescore, `stopped` the queries that stopped before the last impact."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, least_class: int = 3):
        self.ids, self.vectors, self.taken, self.rescored, self.stopped = ids, vectors, 0, 0, 0
        impact = np.abs(vectors.astype(np.float64))
        self.most = impact.max(axis=0, initial=0)
        small = np.int16 if self.most.max(initial=0) < 2**15 else np.int64
        # quantised impact: the number of bits of |value|; zeros have no postings
        classes = np.maximum(np.frexp(impact)[1], least_class).astype(np.int8) * (vectors != 0)
        self.places, self.values, ends = [], [], []
        self.classes = np.unique(classes)[::-1].tolist()
        self.classes = [c for c in self.classes if c > 0]
        for d in range(vectors.shape[1]):
            order = np.argsort(-classes[:, d], kind="stable")[: np.count_nonzero(classes[:, d])].astype(np.int32)
            self.places.append(order)
            self.values.append(vectors[order, d].astype(small))
            ends.append(np.searchsorted(-classes[order, d], [-c for c in self.classes], "right"))
        self.ends = np.array(ends, dtype=np.int64).reshape(vectors.shape[1], len(self.classes))  # [dimension, impact]
        # what of each vector is left after an impact
        self.left = [np.sqrt((np.where(classes < c, impact, 0.0) ** 2).sum(axis=1)) * (1 + 1e-9) for c in self.classes]
        self.by_id = np.argsort(ids, kind="stable")
        self.ranked = ids[self.by_id]

    def at(self, id_: int) -> np.ndarray:
        return self.by_id[np.searchsorted(self.ranked, id_, "left") : np.searchsorted(self.ranked, id_, "right")]

    def _take(self, acc: np.ndarray, weights: np.ndarray, nth: int) -> None:
        """Add the postings of one impact. Where they are few, segment by segment; where most vectors have some, as tiles that
        matrix products add up."""
        dims, kind = weights.shape[1], acc.dtype
        first = self.ends[:, nth - 1] if nth else np.zeros(dims, dtype=np.int64)
        sizes = self.ends[:, nth] - first
        self.taken += int((sizes * np.count_nonzero(weights, axis=0)).sum())
        if sizes.sum() * SPARSE < acc.shape[1] * dims:
            for d in np.flatnonzero(sizes).tolist():
                asking = np.flatnonzero(weights[:, d])
                at, values = (x[d][first[d] : first[d] + sizes[d]] for x in (self.places, self.values))
                acc[np.ix_(asking, at)] += weights[asking, d][:, None] * values.astype(kind)
            return
        tile = np.zeros((dims, acc.shape[1]), dtype=kind)
        for d in range(dims):
            tile[d, self.places[d][first[d] : first[d] + sizes[d]]] = self.values[d][first[d] : first[d] + sizes[d]]
        acc += weights @ tile

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray | None = None):
        """(query, positions, scores) of the k best of every query, ties to smaller ids; its own id takes no part. With floors,
        only scores that reach the query's floor."""
        n, dims = self.vectors.shape
        floors = np.full(len(ids), NO_FLOOR) if floors is None else floors
        reach = float(np.abs(queries.astype(np.float64)).max(axis=0, initial=0) @ self.most)
        kind = np.float32 if reach < 2**24 else np.float64 if reach < 2**53 else np.int64  # sums stay exact
        acc = np.zeros((len(queries), n), dtype=kind)
        for i, q in enumerate(ids.tolist()):
            acc[i, self.at(q)] = TAKEN
        active, weights = np.arange(len(queries)), queries.astype(kind)
        length = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-6)
        for nth in range(len(self.classes)):
            self._take(acc, weights, nth)
            rest = int((self.ends[:, -1] - self.ends[:, nth]).sum())
            left, known, stop = self.left[nth], floors[active] > NO_FLOOR, np.zeros(len(active), dtype=bool)
            tried = 0
            for at, i in enumerate(active.tolist()):
                row, gap = acc[at], length[i] * left if rest else 0
                least = float(floors[i]) if n > k else -np.inf
                if n > k and not known[at]:
                    if rest and (nth < len(self.classes) - 2 or tried >= 8 and not stop[:at].any()):
                        continue  # too early, or none of the block's first queries could stop here
                    tried += 1
                    least = np.partition(row - gap, -k)[-k]
                possible = np.flatnonzero(row + gap >= max(least, TAKEN / 2))
                stop[at] = not rest or len(possible) * dims <= rest
                if stop[at]:
                    self.stopped += rest > 0
                    yield i, *self._best(possible, queries[i], k, floors[i])
            if stop.all():
                return
            if stop.any():
                acc, weights, active = acc[~stop], weights[~stop], active[~stop]
        if not self.classes:  # nothing but zeros
            for i, q in enumerate(ids.tolist()):
                yield i, *self._best(np.setdiff1d(np.arange(n), self.at(q)), queries[i], k, floors[i])

    def _best(self, possible: np.ndarray, query: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        scores = self.vectors[possible] @ query
        self.rescored += scores.size * len(query)
        best = np.lexsort((self.ids[possible], -scores))[:k]
        best = best[scores[best] >= floor]
        return possible[best], scores[best]


def usable(vector: Column) -> Column:
    """Neither null nor holding null or non-finite components; empty vectors hold none and score 0."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & F.coalesce(good, F.lit(False))


def _packed(rows: DataFrame, name: str, blocks: int) -> DataFrame:
    """Rows (id, dims, floor, v) as one row per block of equal length: name, dims, ids, floors, data."""
    named = rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias(name), "dims")
    return named.agg(F.collect_list(F.struct("id", "floor", "v")).alias("of")).select(name, "dims", F.col("of.id").alias("ids"), F.col("of.floor").alias("floors"), F.flatten("of.v").alias("data"))


def _search(batches, k: int):
    """A shard's vectors (block null), then the blocks of queries that meet it -> the k best of every query."""
    index, of = None, None
    for batch in batches:
        for i in range(batch.num_rows):
            at, dims = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py()), batch.column(1)[i].as_py()
            ids, floors = (batch.column(c)[i].values.to_numpy() for c in (3, 4))
            data = batch.column(5)[i].values.to_numpy().reshape(len(ids), dims)
            if not batch.column(2)[i].is_valid:
                of, index = at, ShardIndex(ids, data)
            elif of == at:
                found = [(np.full(len(hits), ids[q]), index.ids[hits], scores) for q, hits, scores in index.search(ids, data, k, floors)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*found, strict=True)], schema=_HITS)


def top_k(
    vectors: DataFrame, *, k: int = 20, scale: int = 64, every: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", shard: int = 16_384, query_block: int = 256
) -> DataFrame:
    """For every vector whose id is divisible by `every`, its k best others by inner product of floor(scale * x).

    Returns query_id, rank, vec_id, score; ties go to the smaller vec_id; queries with fewer than k others get all.
    Vectors that are null or hold null or non-finite components, and rows with a null id, take no part; vectors of
    different length are never compared. Of rows that repeat a query's id the smallest vector of each length asks; none
    of them is its candidate, and for other queries each of them counts. An empty table gives an empty result; other
    columns are ignored, whatever their names. Each block of queries goes to one shard first, then, with the k-th scores
    found there as floors, to the others; what the shards find is cut to k a query before and after it is shuffled.
    """
    rows = vectors.where(usable(F.col(embedding)) & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("id"), F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v")
    )
    none = F.lit(NO_FLOOR).cast("bigint")
    rows = rows.withColumn("dims", F.size("v")).withColumn("floor", none)
    asked = rows.where(F.col("id") % every == 0).groupBy("id", "dims").agg(F.min("v").alias("v"))
    n, n_asked = rows.agg(F.count(F.lit(1)), F.count_if(F.col("id") % every == 0)).first()
    n_shards, n_blocks = max(1, -(-n // shard)), max(1, -(-n_asked // query_block))
    packed = _packed(rows, "shard", n_shards).select("shard", "dims", F.lit(None).cast("bigint").alias("block"), "ids", "floors", "data")
    shards = written(packed, "shards") if n_shards > 1 else packed
    home = F.pmod(F.xxhash64("block"), F.lit(n_shards))

    def searched(blocks: DataFrame) -> DataFrame:
        both = shards.unionByName(blocks.select("shard", "dims", "block", "ids", "floors", "data")).repartition("shard")
        return both.sortWithinPartitions("shard", "dims", F.col("block").asc_nulls_first()).mapInArrow(lambda b: _search(b, k), HITS)

    hits = searched(_packed(asked.withColumn("floor", none), "block", n_blocks).withColumn("shard", home))
    if n_shards > 1:
        hits = written(hits, "first-hits")
        # only queries of one length have all their first hits from one list
        lengths = asked.groupBy("id").agg(F.count(F.lit(1)).alias("lengths"))
        found = hits.groupBy(F.col("query_id").alias("id")).agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).join(lengths, "id").where((F.col("n") >= k) & (F.col("lengths") == 1))
        floored = asked.join(found.select("id", "floor"), "id", "left").withColumn("floor", F.coalesce("floor", none))
        others = F.filter(F.sequence(F.lit(0).cast("bigint"), F.lit(n_shards - 1).cast("bigint")), lambda x: x != home)
        hits = hits.unionByName(searched(_packed(floored, "block", n_blocks).withColumn("shard", F.explode(others))))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
