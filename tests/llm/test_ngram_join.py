import collections
import tracemalloc
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from motifloom.llm import ngram_join as N
from motifloom.llm.graph import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, num, den):
    sets = {d: shingles(t, k) for d, t in rows}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    where = collections.defaultdict(list)
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    shared = collections.Counter((a, b) for ds in where.values() for i, b in enumerate(sorted(ds)) for a in sorted(ds)[:i])
    for (a, b), n in shared.items():
        if den * n >= num * (len(sets[a]) + len(sets[b]) - n):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return {d: (len(s), root(d)) for d, s in sets.items()}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="aAbß \n\t.é\u00a0", max_size=60), max_size=5))
def test_shingle_counts(texts):
    hashes, ends = N.shingle_sets(texts, 3)
    assert np.diff(ends, prepend=0).tolist() == [len(shingles(t, 3)) for t in texts]
    sets = [frozenset(x.tolist()) for x in np.split(hashes, ends[:-1])] if texts else []
    for a, x in zip(texts, sets):
        for b, y in zip(texts, sets):
            assert len(x & y) == len(shingles(a, 3) & shingles(b, 3))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 200), st.integers(0, 2**32), st.sampled_from([(80, 100), (85, 100), (60, 100)]))
def test_linked_sets_show_a_common_shingle(n, seed, threshold):
    """Sets at the very threshold, with the differing shingles anywhere, in any order of the shingles."""
    num, den = threshold
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
    drop = int(rng.integers(0, len(a) + 1))
    b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 2**64, int(rng.integers(0, len(a) + 1)), dtype=np.uint64)]))
    both = len(np.intersect1d(a, b))
    if len(b) and den * both >= num * (len(a) + len(b) - both):
        small, large = sorted((np.sort(N.mix(a)), np.sort(N.mix(b))), key=len)
        assert len(large) <= len(small) * den // num
        shown = set(small[: N.prefix_lengths(len(small), num, den)[1]].tolist())
        assert shown & set(large[: N.prefix_lengths(len(large), num, den)[0]].tolist())
        low, high = (int(np.searchsorted(N.bands(num, den), len(x), side="right")) for x in (small, large))
        assert high - low in (0, 1)


def test_bitmap_bound_never_loses_a_link():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**64, 90, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(base)[: int(rng.integers(60, 90))], rng.integers(0, 2**64, int(rng.integers(0, 9)), dtype=np.uint64)])) for _ in range(40)]
    found = N.cluster_links(list(range(40)), sets, [True] * 40, 80, 100)
    label = list(range(40))
    for a, b in found:
        label = [label[a] if x == label[b] else x for x in label]
    for i in range(40):
        for j in range(i):
            if N.linked(sets[i], sets[j], 80, 100):
                assert label[i] == label[j]


@pytest.mark.parametrize(("words", "num", "block"), [(4, 85, 1000), (5, 80, 4)])
def test_against_brute_force(spark, sf_dir, words, num, block):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], words, num, 100)
    got = N.ngram_components(docs, words=words, num=num, block=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_large_family_in_small_blocks(spark):
    """A chain of near copies and strangers of the same sizes, in blocks far smaller than the family."""
    rng = np.random.default_rng(4)
    base, rows = [f"w{i}" for i in range(60)], []
    for i in range(120):
        words = list(base)
        for p in rng.choice(60, 1 + i // 40, replace=False):
            words[p] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"s{i}_{k}" for k in range(60))) for i in range(10)]
    want = brute(rows, 3, 60, 100)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.ngram_components(docs, words=3, num=60, block=5).collect()}
    assert got == want


def test_bounds_of_pairs():
    """Bitmaps of any two widths: the bound is never below the overlap, and far sets are turned down."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, 70, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(base)[: int(rng.integers(1, 70))], rng.integers(0, 2**64, int(rng.integers(0, 200)), dtype=np.uint64)])) for _ in range(60)]
    bits = [N.bitmap(s, N.bit_width(len(s))).tobytes() for s in sets]
    u, v = np.triu_indices(len(sets), 1)
    size = np.array([len(s) for s in sets])
    rows = pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(size[u]), pa.array(size[v]), pa.array([bits[i] for i in u]), pa.array([bits[i] for i in v])], names=list("abcdef"))
    got = {(r["u"], r["v"]): r["most"] for b in N._bounded([rows], 30, 100) for r in b.to_pylist()}
    for i, j in zip(u.tolist(), v.tolist()):
        both = len(np.intersect1d(sets[i], sets[j]))
        if 100 * both >= 30 * (len(sets[i]) + len(sets[j]) - both):
            assert got[i, j] >= both
    assert len(got) < len(u)


def test_tiles_cut_into_chunks(spark):
    """A shingle that many unlike sets show: the pairs are the same whether its tile is cut or not."""
    rows = [(i, 10 + i % 4, 3, 0, [7, 100 + i % 5]) for i in range(60)]
    shown = spark.createDataFrame(rows, "key bigint, n bigint, band int, alone bigint, shown array<bigint>")
    parts = spark.createDataFrame([(i, i // 2 * 2) for i in range(60)], "key bigint, component bigint")
    got = [{tuple(r) for r in N._candidates(shown, parts, 80, 100, chunk).collect()} for chunk in (1000, 4)]
    size = {r[0]: r[1] for r in rows}
    want = {(a, b) for a in size for b in size if a < b and a // 2 != b // 2 and max(size[a], size[b]) * 80 <= 100 * min(size[a], size[b])}
    assert got[0] == got[1] == want


def test_edges(spark, edge_docs, no_docs):
    got = N.ngram_components(edge_docs, words=5, num=80).collect()
    assert len(got) == edge_docs.count()
    rows = {(r.doc_id, r.n_shingles, r.component_id) for r in got}
    assert {(1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (8, 1, 8), (9, 1, 8), (None, 1, None), (None, 0, None)} <= rows
    assert next(r.component_id for r in got if r.doc_id == 7) == 6
    kept = N.kept_documents(edge_docs, words=5, num=80)
    assert kept.columns == edge_docs.columns and kept.where("doc_id in (2, 7, 9)").count() == 0 and kept.where("doc_id is null").count() == 2
    assert N.ngram_components(no_docs).count() == 0


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, 5000 + i) for i in range(1, 200)]
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    edges = spark.createDataFrame(pairs, "u bigint, v bigint").repartition(7)
    for few in (0, 1000):
        got = {r.node: r.component for r in connected_components(edges, few=few).collect()}
        assert got == {x: root(x) for p in pairs if p[0] != p[1] for x in p}
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0
    assert F is not None


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab \n\u00a0", max_size=200), st.integers(1, 5), st.integers(1, 40))
def test_pieces_hold_every_shingle_once(text, words, most):
    parts = list(N.pieces(text, words, most))
    assert set().union(*(shingles(p, words) for p in parts)) == shingles(text, words)
    assert len(parts) == 1 or all(len(N.CUT.sub(" ", p).split(" ")) >= words for p in parts)


def test_fifty_million_characters_in_bounded_memory():
    text = " ".join(f"w{i * 7919 % 4_000_003:x}" for i in range(6_500_000))
    text += " " * max(0, 50_000_000 - len(text))
    tracemalloc.start()
    hashes, ends = N.shingle_sets(["a b c d", text], 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ends.tolist()[0] == 1 and ends.tolist()[1] == len(hashes) and peak < 1_000_000_000
    assert len(hashes) == 1 + 4_000_003  # the words repeat after that many


def test_common_shingle_comes_once_from_a_portion():
    """Ten thousand sets that all have one shingle and one of their own: a bucket's rows hold the common one once."""
    n = 10_000
    own, owner = np.arange(100_000, 100_000 + n, dtype=np.uint64), np.arange(n)
    hashes = np.concatenate([own, np.full(n, 12345, dtype=np.uint64)])
    rows = N._bucketed(0, list(range(n)), np.full(n, 2), hashes, np.concatenate([owner, owner]), 4, keep=True).to_pylist()
    assert sum(len(r["prints"]) // 4 for r in rows[1:]) == n + 1 and len(rows[0]["prints"]) == 8 * n
    sums = [(o, s) for _, _, owners, sums in N._sums([rows[1], rows[1] | {"batch": 1}]) for o, s in zip(owners.tolist(), sums.tolist())]
    assert [s for o, s in sums if o == N.SEVERAL] == [2 * n] * 2 and {s for o, s in sums if o != N.SEVERAL} == {2}


def test_shingle_of_all_documents(spark):
    """One passage in every document, near copies of some: equal to brute force."""
    rng = np.random.default_rng(3)
    common = "one passage that every document has in common with all the others"
    rows = []
    for d in range(300):
        w = [f"w{x}" for x in rng.integers(0, 10_000, 60)]
        rows.append((3 * d, common + " " + " ".join(w)))
        if d % 3 == 0:
            rows.append((3 * d + 1, common + " " + " ".join(w[:-2])))
    got = N.ngram_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), words=4, num=85, den=100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(rows, 4, 85, 100)
