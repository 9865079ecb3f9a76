import time
import zlib
from unittest import mock

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from motifloom.llm import bitplanes, packing, queries, tokens


@pytest.fixture(scope="module")
def encode():
    return tokens.encoder(tokens.default_tokenizer())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab.,'s \n\t\r1é中\u00a0\x1c!?<|>endoftext")), max_size=40), max_size=4))
def test_parts_encode_like_the_whole(texts):
    e = tokens.encoder(tokens.default_tokenizer())
    assert e(texts) == [e.whole(t) for t in texts]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.sampled_from(["byte", "bit"]))
def test_planes_round_trip(ids, kind):
    ids = np.array(ids, dtype="<u4")
    assert np.array_equal(bitplanes.from_planes(bitplanes.to_planes(ids, kind), len(ids), kind), ids)


def brute_ids(encode, rows, end):
    return {d: np.frombuffer(encode.whole(t or ""), "<u4").tolist() + [end] for d, t in rows}


def test_op1(spark, sf_dir, encode):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    ids, want, start = brute_ids(encode, rows, 2), {}, 0
    for d, _ in rows:
        want[d] = (start, len(ids[d]), zlib.crc32(np.array(ids[d], "<u4").tobytes()))
        start += len(ids[d])
    got = queries.op1_bitplane_tokens(spark, sf_dir).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want and len(got) == len(rows)


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_small_blocks_and_edges(spark, edge_docs, no_docs, encode, tmp_path, kind):
    bitplanes.write_token_file(edge_docs, f"{tmp_path}/t", block=64, kind=kind)
    got = bitplanes.read_token_file(spark, f"{tmp_path}/t").orderBy("start").collect()
    rows = edge_docs.select("doc_id", "text").collect()
    want = sorted(((r.doc_id, encode.whole(r.text or "") + b"\x02\0\0\0") for r in rows), key=lambda x: (x[0] is not None, x[0] or 0))
    assert sorted((str(g.doc_id), bytes(g.ids)) for g in got) == sorted((str(d), i) for d, i in want)
    assert [g.doc_id for g in got] == [d for d, _ in want]
    assert [g.start for g in got] == np.cumsum([0, *(g.n_tokens for g in got[:-1])]).tolist()
    index = spark.read.parquet(f"{tmp_path}/t/index").orderBy("start").collect()
    assert index[0].start == 0 and sum(r.n_ids for r in index) == sum(g.n_tokens for g in got)
    bitplanes.write_token_file(no_docs, f"{tmp_path}/none")
    assert bitplanes.read_token_file(spark, f"{tmp_path}/none").count() == 0


def test_chunks_of_one_long_document_in_linear_time():
    """20 million ids in one document, between short ones: each chunk copies its own ids only."""
    ids = np.arange(20_000_000, dtype="<u4") % 50_000
    stream = [(1, b"\x02\0\0\0"), (2, ids.tobytes()), (3, b"\x07\0\0\0\x02\0\0\0")]
    start = time.perf_counter()
    with mock.patch.object(bitplanes, "to_planes", lambda x, kind: [x.tobytes()]):
        rows = [r for b in bitplanes._chunks(iter(stream), 0, 65_536, "byte") for r in b.to_pylist()]
    assert time.perf_counter() - start < 3
    assert b"".join(r["planes"][0] for r in rows) == b"".join(x for _, x in stream)
    assert [(d["doc_id"], d["first"], d["n"]) for d in rows[-1]["docs"]] == [(2, 1, 20_000_000), (3, 20_000_001, 2)]
    assert all([d["doc_id"] for d in r["docs"]] == [2] for r in rows[1:-1]) and [r["n_ids"] for r in rows[:-1]] == [65_536] * (len(rows) - 1)


def packed_ok(rows, lengths, capacity):
    """Every piece once, gapless sequences of at most capacity."""
    seen, bins = {}, {}
    for r in rows:
        seen.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    for d, pieces in seen.items():
        pieces.sort()
        assert [p for p, _, _ in pieces] == list(range(len(pieces)))
        assert [s for _, s, _ in pieces] == np.cumsum([0, *(n for _, _, n in pieces[:-1])]).tolist()
        assert sum(n for _, _, n in pieces) == lengths[d] and all(n == capacity for _, _, n in pieces[1:])
    assert set(seen) == set(lengths)
    return len(bins)


def test_op8(spark, sf_dir, encode):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    ids = brute_ids(encode, rows, 0)
    got = queries.op8_pack_documents(spark, sf_dir).collect()
    n = packed_ok(got, {d: len(i) for d, i in ids.items()}, 2048)
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    lengths = [r.length for r in got]
    whole = len(set(packing.best_fit(range(len(lengths)), lengths, 2048)[1].tolist()))
    assert n <= whole + 1  # as good as one best-fit pass over everything


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_best_fit(sizes):
    keys, bins, offsets, fill = packing.best_fit(range(len(sizes)), sizes, 50)
    free: list[int] = []
    for s in sorted(sizes, reverse=True):  # the plain rule
        fits = [k for k, f in enumerate(free) if f >= s]
        k = min(fits, key=lambda k: free[k], default=None)
        if k is None:
            free.append(50 - s)
        else:
            free[k] -= s
    assert len(set(bins.tolist())) == len(free)


def test_tree_merges_partitions(spark):
    rows = spark.range(0, 400, 1, 16).selectExpr("id key", "cast(100 + (id * 37) % 1900 as bigint) length")
    places = {r.key: r for r in packing.place_pieces(rows, merge_rows=8).collect()}
    used: dict[int, list] = {}
    for r in rows.collect():
        used.setdefault(places[r.key].sequence_id, []).append((places[r.key].offset, r.length))
    for items in used.values():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert at <= 2048
    assert len(places) == 400
    alone = sum(len(set(packing.best_fit([r.key for r in part], [r.length for r in part], 2048)[1].tolist())) for part in [rows.where(f"key div 25 = {p}").collect() for p in range(16)])
    assert len(used) <= alone


def test_packing_edges(spark, edge_docs, no_docs):
    pieces, places = packing.pack_documents(edge_docs)
    assert pieces.join(places, "key").count() == pieces.count() == places.count()
    assert pieces.where("doc_id = 2").count() == 2 and pieces.where("doc_id is null").count() == 2
    total = packing.packed_sequences(pieces, places).collect()
    assert sum(r.n_tokens for r in total) == pieces.groupBy().sum("length").first()[0]
    pieces, places = packing.pack_documents(no_docs)
    assert places.count() == 0


def test_texts_encoded_together_and_in_slices():
    """Marks, empty lines, white space at either end, nulls and other scripts, in one call and in slices of a column."""
    e = tokens.encoder(tokens.default_tokenizer())
    texts = ["", "one", "one, two.\nthree", None, "a  b", "\n", "x\n\ny", " lead", "trail ", "don't (stop)!", "été, naïve; Ÿ?", "日本 語", "tab\tin", "?!", "\n?! -- one,", "é\u0301a \u00a0b"]
    want = [tokens._as_bytes(e.tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert e(pa.array(texts)) == want
    assert e(pa.array(["other, words"] + texts).slice(1)) == want
    assert e([]) == []
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text": texts})
    for most in (1, 20, 10_000):
        assert list(tokens.encoded(iter([batch, batch.slice(0, 0)]), tokens.default_tokenizer(), 2, most)) == [(i, x + tokens._as_bytes([2])) for i, x in enumerate(want)]
