"""Periodic runs against trying every period at every place, and the query against the contract word by word."""

import hashlib
import random
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest

from motifloom.llm import queries as Q
from motifloom.llm import runs as R


def slow_runs(words, least_words, least_exponent):
    n, found = len(words), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            length = i + p - start
            stretch = words[start : start + length]
            smallest = all(any(stretch[k] != stretch[k + q] for k in range(length - q)) for q in range(1, p))
            if length >= max(least_words, least_exponent * p) and smallest:
                found.append((start, length, p))
            i += 1
    return sorted(found)


def slow_collapsed(words, runs):
    gone = {k for start, length, p in runs for k in range(start + p, start + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def some_words(rng, most=70):
    n, k = rng.randint(0, most), rng.choice([1, 2, 2, 3, 4])
    words = [rng.choice("abcdé"[:k]) for _ in range(n)]
    if n and rng.random() < 0.5:
        a = rng.randrange(n)
        p = 1 + rng.randrange(max(1, (n - a) // 2))
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    for least in ((2, 2), (6, 3), (10, 3), (1, 4)):
        texts = [[w.encode() for w in some_words(rng)] for _ in range(25)]
        texts = [w for w in texts if w]
        for words, rows in zip(texts, R._found(texts, *least), strict=True):
            assert [tuple(r) for r in rows.tolist()] == slow_runs(words, *least)


def test_parts_against_plain_ones():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n = int(rng.integers(2, 200))
        codes = np.append(rng.integers(1, 4, n), 0)
        array, rank = R.suffix_array(codes)
        suffixes = [codes[i:].tolist() for i in range(n + 1)]
        assert array.tolist() == sorted(range(n + 1), key=suffixes.__getitem__) and (rank[array] == np.arange(n + 1)).all()

        def common(i, j):
            k = 0
            while codes[i + k] == codes[j + k]:
                k += 1
            return k

        i, j = rng.integers(0, n + 1, (2, 300))
        i, j = i[i != j], j[i != j]
        got = R.Prefixes(rank, R.lcp_array(codes, array, rank))(i, j)
        assert got.tolist() == [common(a, b) for a, b in zip(i, j)]
        want = [next((k for k in range(i + 1, n + 1) if rank[k] < rank[i]), n + 1) for i in range(n + 1)]
        assert R.next_smaller(rank).tolist() == want


def test_edges(edge_docs, no_docs):
    assert R.periodic_runs(no_docs).count() == 0
    rows = R.periodic_runs(edge_docs).collect()
    given = edge_docs.select("doc_id", "text").collect()
    assert sorted(repr((r.doc_id, r.words, r.runs)) for r in rows) == sorted(
        repr((d.doc_id, len(w := (d.text or "").encode().split()), [R_(*x) for x in slow_runs_of(w)])) for d in given
    )
    assert {r.collapsed for r in rows if r.doc_id in (3, 4, 5)} == {""}
    with pytest.raises(ValueError):
        R.periodic_runs(edge_docs, least_exponent=1)


def R_(start, length, period):
    from pyspark.sql import Row

    return Row(start=start, length=length, period=period)


def slow_runs_of(words):
    if len(words) < 1000:
        return slow_runs(words, 24, 3)
    period = 997  # the fixture's long texts repeat their words at this distance
    end = max(k for k in range(len(words)) if words[k].startswith(b"word")) + 1
    assert all(words[k] == words[k - period] for k in range(period, end))
    return [(0, end, period)]


def test_ten_megabytes_in_one_text(spark):
    text = " ".join(f"w{(i * i) % 100_003}" for i in range(1_000_000)) + " x y z" * 400_000
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    began = time.perf_counter()
    row = R.periodic_runs(docs).first()
    assert time.perf_counter() - began < 60
    assert (1_000_000, 1_200_000, 3) in [(r.start, r.length, r.period) for r in row.runs]
    assert row.words == 2_200_000 and row.collapsed.endswith(" x y z") and row.collapsed.count(" x y z") == 1


def test_query_equals_the_contract(spark, tmp_path):
    rng = random.Random(9)
    rows = [(k, None if k % 17 == 0 else rng.choice([" ", "\n", "\t "]).join(some_words(rng, 120))) for k in range(300)]
    rows += [(5, rows[5][1]), (400, ""), (401, " \n "), (402, "ab cd " * 30), (403, "x\x1cy " * 24), (None, "same " * 30)]
    rows += [(500 + k, "a b " * (12 + k) + "x " + "c d e " * 9 + "y " + "f " * 24) for k in range(20)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, Q.op11_periodic_runs(spark, str(tmp_path)).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()), key=repr)
    want = []
    for doc_id, text in rows:
        words = [w.decode() for w in (text or "").encode().split()]
        n = len(words)
        if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = slow_runs(words, 24, 3)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((doc_id, len(runs), *top, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(slow_collapsed(words, runs))))
    assert got == sorted(want, key=repr)
    assert sum(r[1] > 2 for r in got) > 3
