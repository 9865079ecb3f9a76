"""Token files of shuffled planes.

A token file is a folder of two Parquet tables, so that any store Spark can write to holds it and Spark's committer
decides which attempt of a lost task counts:

* ``chunks`` - part, chunk, first, n_ids, planes, docs. A part is the token stream of one range of ids; its documents are
  laid end to end and cut into blocks of BLOCK ids. A block's 32-bit ids are transposed into byte planes (all lowest
  bytes, then all second bytes, ...) or bit planes, and each plane is compressed with zstandard on its own: the high
  planes are nearly constant and vanish. `first` counts ids from the part's start; `docs` lists the documents that the
  block overlaps with their first id and length.
* ``index`` - part, chunk, start, n_ids, n_docs, first_doc, last_doc, bytes: where each chunk starts in the whole stream.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import beside, body, tidy
from .tokens import default_tokenizer, encoded

BLOCK = 65_536
CHUNKS = "part int, chunk int, first bigint, n_ids int, kind string, planes array<binary>, docs array<struct<doc_id:bigint,first:bigint,n:bigint>>"
SEGMENTS = "part int, doc_id bigint, first bigint, n_tokens bigint, at bigint, ids binary"
_CHUNKS = pa.schema(
    [("part", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()), ("kind", pa.string()), ("planes", pa.list_(pa.binary()))]
    + [("docs", pa.list_(pa.struct([("doc_id", pa.int64()), ("first", pa.int64()), ("n", pa.int64())])))]
)
_SEGMENTS = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64()), ("at", pa.int64()), ("ids", pa.binary())])


def to_planes(ids: np.ndarray, kind: str = "byte", level: int = 3) -> list[bytes]:
    """Transpose a block of ids into 4 byte planes or 32 bit planes and compress each."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=level).compress
    octets = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    if kind == "byte":
        return [pack(x.tobytes()) for x in octets]
    return [pack(np.packbits((x >> bit) & 1, bitorder="little").tobytes()) for x in octets for bit in range(8)]


def from_planes(planes: list[bytes], n: int, kind: str = "byte") -> np.ndarray:
    """The inverse of to_planes."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    rows = [np.frombuffer(unpack(x), dtype=np.uint8) for x in planes]
    if kind == "bit":
        bits = [np.unpackbits(x, count=n, bitorder="little") for x in rows]
        rows = [sum(bits[8 * k + b] << b for b in range(8)).astype(np.uint8) for k in range(4)]
    return np.ascontiguousarray(np.stack(rows, axis=1)).view("<u4").reshape(-1)


def _chunks(stream: Iterator[tuple[int | None, bytes]], part: int, block: int, kind: str) -> Iterator[pa.RecordBatch]:
    held, taken, size, chunk, at = deque(), 0, 0, 0, 0  # texts' ids not yet cut, bytes gone of the first, ids left; next chunk; ids so far
    docs: list[dict] = []

    def cut(n: int) -> pa.RecordBatch:
        nonlocal taken, size, chunk, docs
        raw, missing = [], 4 * n
        while missing:
            raw.append(memoryview(held[0])[taken : taken + missing])
            missing, taken = missing - len(raw[-1]), taken + len(raw[-1])
            if taken == len(held[0]):
                held.popleft()
                taken = 0
        ids = np.frombuffer(b"".join(raw), dtype="<u4")
        low = chunk * block
        row = {"part": part, "chunk": chunk, "first": low, "n_ids": n, "kind": kind, "planes": to_planes(ids, kind), "docs": [d for d in docs if d["first"] < low + n]}
        size, chunk = size - n, chunk + 1
        docs = [d for d in docs if d["first"] + d["n"] > low + n]
        return pa.RecordBatch.from_pylist([row], schema=_CHUNKS)

    for key, ids in stream:
        docs.append({"doc_id": key, "first": at, "n": len(ids) // 4})
        held.append(ids)
        at, size = at + len(ids) // 4, size + len(ids) // 4
        while size >= block:
            yield cut(block)
    if size:
        yield cut(size)


def write_token_file(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = 2, block: int = BLOCK, kind: str = "byte") -> None:
    """Encode every whole text and write the ids, with end_id after each document, in ascending id order.

    Null ids come first, null texts count as empty (just the end id), rows that repeat an id stand next to each other, in
    the order of a hash of the text and then the text, so that many of them are still dealt to many tasks. Other columns
    are ignored. An empty table gives empty tables.
    """
    tokenizer = tokenizer or default_tokenizer()

    def write(batches):
        return _chunks(encoded(batches, tokenizer, end_id), TaskContext.get().partitionId(), block, kind)

    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), body(text).alias("text"))
    rows = rows.select("id", "text", F.xxhash64("text").alias("print")).repartitionByRange("id", "print").sortWithinPartitions("id", "print", "text")
    rows.select("id", "text").mapInArrow(tidy(write), CHUNKS).write.option("compression", "none").parquet(f"{path}/chunks")
    chunks = spark.read.schema(CHUNKS).parquet(f"{path}/chunks")
    sizes = F.aggregate(F.transform("planes", lambda x: F.length(x)), F.lit(0), lambda a, x: a + x)
    start = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = chunks.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select(F.col("part"), start.alias("base"))  # a row per task
    index = chunks.join(F.broadcast(parts), "part").select(
        "part", "chunk", (F.col("base") + F.col("first")).alias("start"), "n_ids", F.size("docs").alias("n_docs"), F.col("docs")[0]["doc_id"].alias("first_doc"), F.element_at("docs", -1)["doc_id"].alias("last_doc"), sizes.alias("bytes")
    )
    index.write.parquet(f"{path}/index")


def _segments(batches, whole: bool):
    """The documents that lie in one chunk, or the pieces of those that do not."""
    for batch in batches:
        part, n_ids, low = (batch.column(c).to_numpy() for c in ("part", "n_ids", "first"))
        kind, planes, docs = (batch.column(c) for c in ("kind", "planes", "docs"))
        for i in range(batch.num_rows):
            held = docs[i].values
            first, n = held.field("first").to_numpy(), held.field("n").to_numpy()
            start, stop = np.maximum(first, low[i]), np.minimum(first + n, low[i] + n_ids[i])
            at = np.flatnonzero((stop - start == n) == whole)
            if not len(at):
                continue
            ids = from_planes(planes[i].as_py(), int(n_ids[i]), kind[i].as_py()).tobytes()
            cuts = zip(((start[at] - low[i]) * 4).tolist(), ((stop[at] - low[i]) * 4).tolist(), strict=True)
            columns = [pa.array(np.full(len(at), part[i])), held.field("doc_id").take(pa.array(at)), pa.array(first[at]), pa.array(n[at]), pa.array(start[at])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([ids[x:y] for x, y in cuts], pa.binary())], schema=_SEGMENTS)


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) of every document of a token file.

    Documents that lie in one chunk come straight from it; only the pieces of the others are brought together.
    """
    chunks = spark.read.schema(CHUNKS).parquet(f"{path}/chunks")
    index = spark.read.schema("part int, chunk int, start bigint").parquet(f"{path}/index")
    starts = beside(index.where("chunk = 0").select("part", F.col("start").alias("base")))  # a row per written task
    whole = chunks.mapInArrow(tidy(lambda b: _segments(b, True)), SEGMENTS).select("part", "doc_id", "first", "n_tokens", "ids")
    pieces = chunks.mapInArrow(tidy(lambda b: _segments(b, False)), SEGMENTS)
    joined = F.aggregate(F.array_sort(F.collect_list(F.struct("at", "ids"))), F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    cut = pieces.groupBy("part", "first", "doc_id", "n_tokens").agg(joined.alias("ids"))
    rows = whole.unionByName(cut.select("part", "doc_id", "first", "n_tokens", "ids")).join(starts, "part")
    return rows.select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids")
