"""Best-fit packing of token documents by hierarchical residual packing.

Every task packs the pieces it has read by best fit (largest first), and bins that are full or nearly full are final.
The underfull bins become the items of the next round: they are dealt to fewer tasks, packed by best fit again, and so
on up a tree until one task sees all that is left or a round no longer helps. What moves up the tree is a key and a fill
level; a bin is named after its first piece, so merging bins just maps names to names.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import body, tidy, written
from .tokens import default_tokenizer, encoded

PIECES = "key bigint, doc_id bigint, piece int, start bigint, length bigint, ids binary"
_PIECES = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])
PLACES = "key bigint, bin bigint, offset bigint, fill bigint"


def best_fit(keys: Iterable[int], sizes: Iterable[int], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing. Returns key, bin (key of the bin's first item), offset and the bin's fill, per item.

    open_[f] holds the bins with f free places and a bit of `some` tells where there are any, so that the tightest bin
    for an item is the lowest set bit at or above its size. Ties go by key.
    """
    keys, sizes = np.asarray(keys, dtype=np.int64), np.asarray(sizes, dtype=np.int64)
    order = np.lexsort((keys, -sizes))
    bins, offsets, fill = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64), {}
    open_: dict[int, list[int]] = {}
    some = 0
    for i in order.tolist():
        key, size = int(keys[i]), int(sizes[i])
        at = some >> size
        if at:
            free = size + (at & -at).bit_length() - 1
            bin_ = open_[free].pop()
            if not open_[free]:
                some ^= 1 << free
        else:
            free, bin_ = capacity, key
        bins[i], offsets[i] = bin_, capacity - free
        free -= size
        fill[bin_] = capacity - free
        if free:
            open_.setdefault(free, []).append(bin_)
            some |= 1 << free
    return keys, bins, offsets, np.array([fill[b] for b in bins.tolist()], dtype=np.int64)


def _packed(batches, capacity: int):
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if held:
        found = best_fit(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]), capacity)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["key", "bin", "offset", "fill"])


def cut_documents(docs: DataFrame, *, capacity: int = 2048, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """key, doc_id, piece, start, length, ids: every document's ids with the end id; longer ones in pieces of
    `capacity` ids, the first piece holding what is over. Written, so that the keys stand."""
    tokenizer = tokenizer or default_tokenizer()

    def cut(batches):
        key, rows, size = TaskContext.get().partitionId() << 36, [], 0
        for doc, ids in encoded(batches, tokenizer, end_id):
            n, start = len(ids) // 4, 0
            for piece in range(-(-n // capacity)):
                length = (n % capacity or capacity) if piece == 0 else capacity
                rows.append({"key": key, "doc_id": doc, "piece": piece, "start": start, "length": length, "ids": ids[4 * start : 4 * (start + length)]})
                key, start = key + 1, start + length
            size += len(ids)
            if size >= 8_000_000:
                yield pa.RecordBatch.from_pylist(rows, schema=_PIECES)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_PIECES)

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), body(text).alias("text"))
    return written(rows.mapInArrow(tidy(cut), PIECES), "pack-pieces")


def place_pieces(pieces: DataFrame, *, capacity: int = 2048, slack: int = 16, merge_rows: int = 100_000) -> DataFrame:
    """key, sequence_id, offset of every piece (key, length).

    Bins with at most `slack` free places are final. merge_rows is how many underfull bins a task of the next round
    gets; rounds end when one task has had all of them, or when a round has merged less than a hundredth.
    """

    def pack(batches):
        return _packed(batches, capacity)

    full = pieces.where(F.col("length") >= capacity).select("key", F.col("key").alias("bin"), F.lit(0).cast("long").alias("offset"))
    places = written(pieces.where(F.col("length") < capacity).select("key", "length").mapInArrow(tidy(pack), PLACES), "pack-places")
    level, moves = places, None
    while True:
        under = level.where((F.col("key") == F.col("bin")) & (F.col("fill") < capacity - slack)).select("key", "fill")
        n = under.count()
        if n < 2:
            break
        groups = math.ceil(n / merge_rows)
        level = written(under.repartition(groups, "key").mapInArrow(tidy(pack), PLACES), "pack-level")
        step = level.where(F.col("key") != F.col("bin")).select(F.col("key").alias("from"), F.col("bin").alias("to"), F.col("offset").alias("shift"))
        merged = step.count()
        if merged and moves is None:
            moves = step
        elif merged:
            on = moves.join(step.toDF("_from", "_to", "_shift"), F.col("to") == F.col("_from"), "left")
            on = on.select("from", F.coalesce("_to", "to").alias("to"), (F.col("shift") + F.coalesce("_shift", F.lit(0))).alias("shift"))
            moves = written(on.unionByName(step), "pack-moves")
        if groups == 1 or merged < n / 100:
            break
    local = places.select("key", "bin", "offset")
    if moves is not None:
        local = local.join(moves, F.col("bin") == F.col("from"), "left")
        local = local.select("key", F.coalesce("to", "bin").alias("bin"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
    return full.unionByName(local).select("key", F.col("bin").alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, *, capacity: int = 2048, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = 0, slack: int = 16) -> tuple[DataFrame, DataFrame]:
    """Pack all documents into sequences of at most `capacity` tokens.

    Returns (pieces, places): pieces as of cut_documents, with the ids, and places as of place_pieces; join them on key.
    Null texts count as empty and give one piece, the end id. Rows that repeat an id are packed as often as they stand
    there. An empty table gives empty tables. Other columns are ignored.
    """
    pieces = cut_documents(docs, capacity=capacity, doc_id=doc_id, text=text, tokenizer=tokenizer, end_id=end_id)
    return pieces, place_pieces(pieces.select("key", "length"), capacity=capacity, slack=slack)


def packed_sequences(pieces: DataFrame, places: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, n_tokens, ids, doc_ids (a document per piece, in order)."""
    rows = pieces.join(places, "key").groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("of"))
    ids = F.aggregate("of", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return rows.select("sequence_id", ids.alias("ids"), F.transform("of", lambda x: x["doc_id"]).alias("doc_ids")).withColumn("n_tokens", F.length("ids") / 4)
