"""WARC archives: exact round trips, revisits against a plain rule, and files that are cut off."""

import gzip
import hashlib
import random

import pytest

from motifloom.llm import queries as Q
from motifloom.llm import warc


def some_payload(rng):
    parts = ["\r\n\r\n", "\r\n", "\r", "\n", "WARC/1.1\r\nContent-Length: 3\r\n\r\n", "<p>é\U0001f600</p>", "a", "\0", "Content-Length: 9"]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))


def test_round_trip_of_any_payload(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k, f"http://h/{k}", some_payload(rng)) for k in range(400)] + [(1000, None, None), (1001, "http://x/a b\r\nc", "x\r\n" * 40_000), (None, "", "y")]
    made = warc.with_revisits(spark.createDataFrame(rows, "key bigint, uri string, payload string").repartition(3))
    warc.write_archive(made, str(tmp_path / "a"), date="2020-01-01T00:00:00Z")
    got = {r.key: r for r in warc.read_archive(spark, str(tmp_path / "a")).collect()}
    assert len(got) == len(rows)
    texts = {}
    for key, uri, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        full = (text or "").encode()
        first = texts.setdefault(full, key) if len(full) >= 100 else key
        r = got[key]
        assert r.payload_digest == hashlib.sha256(full).hexdigest() and r.record_type == ("response" if first == key else "revisit")
        assert r.payload == (full if first == key else None) and r.payload_bytes == (len(full) if first == key else None)
        assert r.refers_to == (None if first == key else got[first].record_id)
        assert r.uri == {1000: None, 1001: "http://x/a%20b%0D%0Ac", None: None}.get(key, uri)
    assert len({r.record_id for r in got.values()}) == len(rows)


def test_files_are_plain_gzip_warc(spark, tmp_path):
    made = warc.with_revisits(spark.createDataFrame([(1, "http://a/", "é" * 60), (2, "http://b/", "é" * 60)], "key int, uri string, payload string").coalesce(1))
    warc.write_archive(made, str(tmp_path / "a"), date="2020-01-01T00:00:00Z")
    (file,) = (tmp_path / "a").glob("part-*.gz")
    raw = gzip.decompress(file.read_bytes())
    records = raw.split(b"WARC/1.1\r\n")[1:]
    assert len(records) == 2 and all(r.endswith(b"\r\n\r\n") for r in records)
    for record in records:
        head, _, rest = record.partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n"))
        assert len(rest) == int(fields[b"Content-Length"]) + 4 and fields[b"WARC-Date"] == b"2020-01-01T00:00:00Z"
        if fields[b"WARC-Type"] == b"revisit":
            assert fields[b"WARC-Refers-To-Target-URI"] == b"http://a/" and fields[b"WARC-Profile"].decode() == warc.PROFILE


def test_cut_off_and_foreign_files(spark, tmp_path):
    whole = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\nWARC-Type: resource\r\nX-A: 1\r\n  2\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    (tmp_path / "good.gz").write_bytes(gzip.compress(whole))
    got = warc.read_archive(spark, str(tmp_path / "good.gz")).collect()
    assert [(r.record_type, r.payload, r.key) for r in got] == [("warcinfo", b"abc", None), ("resource", b"", None)]
    for bad in (whole[:60], b"WARC/1.0\r\nContent-Length: 3\r\n\r\nabcdef\r\n\r\n", b"hello\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.cut_records((f"{len(bad)}", x) for x in bad.split(b"\r\n\r\n")))
    with pytest.raises(ValueError):
        list(warc.cut_records([("a", b"WARC/1.0\r\nContent-Length: 9"), ("a", b"abc"), ("b", b"WARC/1.0\r\nContent-Length: 0")]))


def test_repeated_rows_nulls_and_empty_tables(spark, tmp_path):
    text = "t" * 100
    rows = [(7, "u", text)] * 5 + [(7, "a", text)] * 2 + [(9, "u", text), (None, "u", text), (None, "u", text), (7, "u", "small")] + [(8, "u", "small")] * 3 + [(5, None, None), (5, None, None)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, digest string, bytes int")
    docs.write.parquet(str(tmp_path / "pages.parquet"))
    got = [(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in Q.op13_warc_revisits(spark, str(tmp_path)).collect()]
    want = [(7, 100, "response", None)] + [(7, 100, "revisit", 7)] * 6 + [(9, 100, "revisit", 7)] + [(None, 100, "revisit", 7)] * 2
    want += [(7, 5, "response", None)] + [(8, 5, "response", None)] * 3 + [(5, 0, "response", None)] * 2
    assert sorted(got, key=repr) == sorted(want, key=repr)
    made = warc.with_revisits(docs.where("page_id is null"), key="page_id", uri="url", payload="html").collect()
    assert sorted(r.record_type for r in made) == ["response", "revisit"] and len({r.record_id for r in made}) == 2
    empty = tmp_path / "none"
    docs.limit(0).write.parquet(str(empty / "pages.parquet"))
    assert Q.op13_warc_revisits(spark, str(empty)).count() == 0


def test_revisits_without_their_response_stay(spark, tmp_path):
    rows = spark.createDataFrame([("<a>", "revisit", None, None, "<b>", "d", None, None)], warc.RECORDS)
    (r,) = warc.with_originals(rows).collect()
    assert (r.refers_to_key, r.payload_bytes) == (None, None)
