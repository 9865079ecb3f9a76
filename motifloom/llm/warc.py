"""WARC archives with revisit records.

Payload digests decide which record keeps its payload. Only headers (digest, key, length) are shuffled by digest; each
group of equal payloads gets its original response, rows are joined to the originals, and every other record of the
group becomes a revisit record that refers to it. Archives are written by Spark's text writer, one gzip file per task:
a record is one line whose line separator is the pair of line ends that WARC puts behind a record. So any store that
Spark can write to holds them, and Spark's committer decides which attempt of a lost task counts.

A reader goes through each file as a stream of such lines and cuts records by their Content-Length, whatever the payloads
hold; no file is held in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import beside, tidy, written

LEAST_BYTES = 100
END = "\r\n"
GAP = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
KEY = "X-Record-Key"
RUN = 65_536  # repeated rows that one row is written out to at a time
RECORDS = "record_id string, record_type string, key bigint, uri string, refers_to string, payload_digest string, payload_bytes bigint, payload binary"
_RECORDS = pa.schema(
    [("record_id", pa.string()), ("record_type", pa.string()), ("key", pa.int64()), ("uri", pa.string()), ("refers_to", pa.string())]
    + [("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]
)


def _record_id(key: Column, digest: Column, nth: Column) -> Column:
    name = F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("null")), digest, nth.cast("string")))
    return F.regexp_replace(name, "(.{8})(.{4})(.{4})(.{4})(.{12})", "<urn:uuid:$1-$2-$3-$4-$5>")


def _numbered(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Adds nth: 1, but for rows that repeat key and payload, which are numbered by their uris.

    Such rows are folded by the map side before they meet, and written out again afterwards.
    """
    again = written(headers.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "digest"), "warc-repeats")
    if again.isEmpty():
        return rows.withColumn("nth", F.lit(1).cast("bigint"))
    again = beside(again.select(F.col("key").alias("_key"), F.col("digest").alias("_digest")), 200_000)  # about 100 bytes a row
    met = F.col("key").eqNullSafe(F.col("_key")) & (F.col("digest") == F.col("_digest"))
    alone = rows.join(again, met, "left_anti").withColumn("nth", F.lit(1).cast("bigint"))
    folded = rows.join(again, met, "left_semi").groupBy("key", "uri", "digest").agg(F.any_value("payload").alias("payload"), F.any_value("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key", "digest").orderBy("uri").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = folded.withColumn("before", before).withColumn("run", F.explode(F.expr(f"sequence(0L, (n - 1) div {RUN})")))
    each = runs.withColumn("at", F.explode(F.expr(f"sequence(1L, least({RUN}L, n - run * {RUN}))")))
    numbered = each.withColumn("nth", F.col("before") + F.col("run") * RUN + F.col("at"))
    return alone.unionByName(numbered.select(*alone.columns))


def with_revisits(records: DataFrame, *, key: str = "key", uri: str = "uri", payload: str = "payload", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Decide for every record whether it is a response or revisits one of equal payload.

    records: an integer key, a uri and a payload (text, taken as UTF-8, or bytes). Of records with equal payloads of at
    least `least_bytes` bytes the one with the smallest key is the response and the others are revisits; smaller
    payloads are all responses. A null key loses to any other, and of rows that repeat key and payload the one with the
    smallest uri is first. A null payload is empty, a null or empty uri is left out. Other columns are dropped, whatever
    their names; an empty table gives an empty one. Payloads are equal where their SHA-256 is.

    Returns record_id, record_type, key, uri, payload (null for revisits), digest, bytes, refers_to (record id),
    refers_to_uri.
    """
    full = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = records.select(F.col(key).cast("bigint").alias("key"), F.col(uri).cast("string").alias("uri"), full.alias("payload"))
    rows = rows.select("*", F.sha2("payload", 256).alias("digest"), F.length("payload").cast("bigint").alias("bytes"))
    headers = written(rows.select("key", "uri", "digest", "bytes"), "warc-headers")
    first = F.min(F.struct(F.col("key").isNull().alias("last"), "key", "uri")).alias("first")
    groups = headers.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(first, F.count(F.lit(1)).alias("n"))
    named = groups.where("n > 1").select("digest", F.lit(True).alias("shared"), F.col("first.key").alias("first_key"), F.col("first.uri").alias("first_uri"))
    originals = written(named, "warc-originals")
    rows = _numbered(rows, headers).join(beside(originals, 100_000), "digest", "left")  # about 200 bytes a row
    revisit = F.coalesce(F.col("shared") & ~((F.col("nth") == 1) & F.col("key").eqNullSafe(F.col("first_key"))), F.lit(False))
    rows = rows.withColumn("revisit", revisit)
    refers = F.when(F.col("revisit"), _record_id(F.col("first_key"), F.col("digest"), F.lit(1)))
    return rows.select(
        _record_id(F.col("key"), F.col("digest"), F.col("nth")).alias("record_id"), F.when(F.col("revisit"), "revisit").otherwise("response").alias("record_type"), "key", "uri",
        F.when(~F.col("revisit"), F.col("payload")).alias("payload"), "digest", "bytes", refers.alias("refers_to"), F.when(F.col("revisit"), F.col("first_uri")).alias("refers_to_uri"),
    )


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null or empty."""
    return F.coalesce(F.when(value != "", F.concat(F.lit(f"{name}: "), value, F.lit(END))), F.lit(""))


def _one_line(uri: str) -> Column:
    """The uri with white space percent-encoded, so that it cannot end its header line."""
    told = F.col(uri)
    for c in " \t\n\v\f\r":
        told = F.replace(told, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return told


def write_archive(records: DataFrame, path: str, *, date: str | None = None) -> None:
    """Write the records of with_revisits as gzip WARC files under path, each with fresh headers.

    `date` (WARC-Date) is the time of the call unless given. White space in uris is percent-encoded. Payloads are written
    whole, whatever they hold. One file per task.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("bytes").cast("string"), F.lit(END + END)).cast("binary")
    block = F.concat(http, F.coalesce(F.col("payload"), F.lit(b"")))
    head = F.concat(
        F.lit(f"WARC/1.1{END}"), _field("WARC-Type", F.col("record_type")), _field("WARC-Record-ID", F.col("record_id")), F.lit(f"WARC-Date: {date}{END}"),
        _field("WARC-Target-URI", _one_line("uri")), _field(KEY, F.col("key").cast("string")), _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}{END}")).otherwise(F.lit("")), _field("WARC-Refers-To", F.col("refers_to")), _field("WARC-Refers-To-Target-URI", _one_line("refers_to_uri")),
        F.lit(f"Content-Type: application/http;msgtype=response{END}Content-Length: "), F.length("block").cast("string"), F.lit(END + END),
    )
    lines = records.withColumn("block", block).select(F.concat(head.cast("binary"), F.col("block")).cast("string").alias("value"))
    lines.write.option("compression", "gzip").option("lineSep", END + END).text(path)


def _fields(head: bytes) -> dict[bytes, bytes]:
    """Header lines by lower-case name; a line that starts with white space continues the one before."""
    found, last = {}, None
    for line in head.split(b"\r\n")[1:]:
        if line[:1] in (b" ", b"\t") and last is not None:
            found[last] += b" " + line.strip()
            continue
        name, colon, value = line.partition(b":")
        if colon:
            last = name.strip().lower()
            found[last] = value.strip()
    return found


def cut_records(lines: Iterable[tuple[str, bytes]]) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """(header fields, block) of every record of the files whose lines (file, bytes up to the next pair of line ends) come in
    order. ValueError where a file ends within a record or holds something else between records."""
    file, head, parts, have, need, rest = None, None, [], 0, 0, b""
    for name, line in lines:
        if name != file:
            if head is not None or rest.strip():
                raise ValueError(f"{file} ends within a record")
            file, rest = name, b""
        if head is None:
            line = (rest + line).lstrip(b"\r\n")
            rest = b""
            if not line:
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"{file} holds something else than a record: {line[:40]!r}")
            head = _fields(line)
            parts, have, need = [], 0, int(head.get(b"content-length", b"0"))
        else:
            parts.append(line)
            have += len(line)
            if have < need:  # the separator belongs to the block, or its first bytes do
                parts.append(GAP)
                have += len(GAP)
                if have >= need:
                    rest = GAP[len(GAP) - (have - need) :] if have > need else b""
                    block = b"".join(parts)[:need]
                    if have == need:
                        continue  # the record's own separator is still to come
                    yield head, block
                    head = None
                continue
        if have == need:
            yield head, b"".join(parts)
            head = None
        elif have > need:
            raise ValueError(f"{file}: a block is longer than its Content-Length")
    if head is not None or rest.strip():
        raise ValueError(f"{file} ends within a record")


def _read(lines: Iterable[tuple[str, bytes]], payloads: bool) -> Iterator[dict]:
    text = lambda b: None if b is None else b.decode("utf-8", "replace")
    for head, block in cut_records(lines):
        kind = text(head.get(b"warc-type"))
        payload = block.partition(GAP)[2] if head.get(b"content-type", b"").startswith(b"application/http") else block
        told = text(head.get(b"warc-payload-digest"))
        told = told and told.removeprefix("sha256:")
        key = head.get(KEY.lower().encode())
        whole = kind != "revisit"
        yield {
            "record_id": text(head.get(b"warc-record-id")), "record_type": kind, "key": None if key is None else int(key), "uri": text(head.get(b"warc-target-uri")), "refers_to": text(head.get(b"warc-refers-to")),
            "payload_digest": hashlib.sha256(payload).hexdigest() if whole else told, "payload_bytes": len(payload) if whole else None, "payload": payload if whole and payloads else None,
        }


def read_archive(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """Records of the gzip WARC files under path: record_id, record_type, key, uri, refers_to, payload_digest, payload_bytes,
    payload.

    Digest and length are taken from the payload that was read; a revisit record has no payload, so its digest is the one
    that its header states and its length is null (see with_originals). HTTP headers are no part of a payload. Files are
    streamed; a file that ends within a record is an error. An empty folder gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lines():
            for batch in batches:
                for file, value in zip(batch.column(0), batch.column(1), strict=True):
                    yield file.as_py(), value.as_py()

        held, size = [], 0
        for record in _read(lines(), payloads):
            held.append(record)
            size += 500 + len(record["payload"] or b"")
            if size > 4_000_000:
                yield pa.RecordBatch.from_pylist(held, schema=_RECORDS)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=_RECORDS)

    lines = spark.read.schema("value string").option("lineSep", END + END).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value")).mapInArrow(tidy(run), RECORDS)


def with_originals(records: DataFrame) -> DataFrame:
    """The records of read_archive without payloads, with the original of each revisit: refers_to_key, and payload_bytes of the
    original. Revisits whose response is not among the records keep null in both.

    Wanted ids are made distinct before they meet the responses, so a response that a third of all records revisit is
    one row there.
    """
    heads = records.drop("payload")
    wanted = heads.where("record_type = 'revisit'").select(F.col("refers_to").alias("record_id")).distinct()
    found = heads.where("record_type = 'response'").join(wanted, "record_id", "left_semi").dropDuplicates(["record_id"])
    found = written(found.select(F.col("record_id").alias("refers_to"), F.col("key").alias("refers_to_key"), F.col("payload_bytes").alias("_bytes")), "warc-referred")
    rows = heads.join(beside(found, 100_000), "refers_to", "left")
    return rows.withColumn("payload_bytes", F.coalesce("payload_bytes", "_bytes")).drop("_bytes")
