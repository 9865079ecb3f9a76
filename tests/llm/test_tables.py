"""Exact dedup, mixing and url filter: SQL twins, fixtures and edges."""

import hashlib
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from motifloom.llm import exact_dedup, mixing, ngram_join, queries, url_filter

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(name, same):
    same(queries.queries()[name], SQL[name])


def test_dedup_edges(edge_docs, no_docs):
    got = exact_dedup.exact_dedup(edge_docs).collect()
    assert len(got) == edge_docs.count()
    same = [r for r in got if r.doc_id in (1, 2)]
    assert {r.keep_id for r in same} == {2} and {r.group_size for r in same} == {3} and sum(r.kept for r in same) == 1
    empty = [r for r in got if r.text_sha256 == hashlib.sha256(b"").hexdigest()]
    assert len(empty) == 3 and {r.keep_id for r in empty} == {4} and sum(r.kept for r in empty) == 1
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})
    kept = exact_dedup.kept_documents(edge_docs)
    assert kept.columns == edge_docs.columns and kept.count() == sum(r.kept for r in got)
    assert exact_dedup.exact_dedup(no_docs).count() == 0


def test_dedup_hot_text(spark):
    rows = spark.range(0, 3000, 1, 24).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup.exact_dedup(rows, salts=4)
    assert got.where("kept").count() == 2001 and got.where("keep_id = 2997 and group_size = 1000").count() == 1000


def test_dedup_where_digests_clash(spark, edge_docs):
    """With a digest that many texts share, rows still meet their group by content."""
    rough = lambda text: F.substring(F.sha2(text, 256), 1, 1)
    same = lambda df: sorted(map(str, df.collect()))
    docs = spark.range(0, 200).select((F.col("id") % 190).alias("doc_id"), (F.col("id") % 60).cast("string").alias("text"))
    for some in (docs, edge_docs):
        assert same(exact_dedup.exact_dedup(some, digest=rough)) == same(exact_dedup.exact_dedup(some))
        assert same(exact_dedup.kept_documents(some, digest=rough)) == same(exact_dedup.kept_documents(some))


def test_filters_keep_columns_of_any_name(spark):
    rows = [(1, "a b c", "s", 5, 7), (1, "a b c", "s", 3, 7), (2, "a b c d", None, 1, 8), (3, None, "s", 2, 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars bigint, mark bigint")
    names = ("_digest", "_kept_id", "_words", "_size", "_taken", "_mix_id", "row", "name", "nth", "print", "body", "digest", "cut", "words", "total")
    docs = docs.select("*", *[F.concat(F.lit(c), F.col("mark")).alias(c) for c in names])
    for out in (exact_dedup.kept_documents(docs), mixing.mixed_documents(docs), ngram_join.kept_documents(docs)):
        assert out.columns == docs.columns and out.count() > 0
        assert all(r[c] == f"{c}{r.mark}" for r in out.collect() for c in names)
    assert exact_dedup.kept_documents(docs).where("doc_id = 1").first().n_chars == 3


def plain_targets(sizes, weights=(3, 1, 2)):
    """Share by weight, cap, deal the excess again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, target, open_ = 1.5 * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while total > 1e-9 and open_:
        level = total / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] >= 2 * sizes[s]}
        if not over:
            for s in open_:
                target[s] = level * w[s]
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            total -= target[s]
        open_ -= over
    return target


def test_mixing(spark, sf_dir, edge_docs, no_docs):
    for docs in (spark.read.parquet(f"{sf_dir}/documents.parquet"), edge_docs):
        got = mixing.mix_sources(docs).join(docs.select(F.col("doc_id").alias("d"), "source").distinct(), F.col("doc_id").eqNullSafe(F.col("d")), "left")
        rows = mixing.mix_sources(docs).collect()
        assert len(rows) == docs.count() and all(0 <= r.taken <= 2 * r.size for r in rows)
        sizes = {r.source: r.n for r in docs.groupBy("source").agg(F.sum(mixing.n_words()).alias("n")).collect()}
        want = plain_targets(sizes)
        if docs is not edge_docs:
            for r in got.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect():
                assert r.g == pytest.approx(want[r.source]) and r.t == int(r.g)
        else:
            assert sum(r.taken for r in rows) == sum(int(x + 1e-9) for x in want.values())
        assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_sources(docs).collect()))
    assert mixing.mix_sources(no_docs).count() == 0


def test_mixed_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words = out.groupBy("doc_id").agg(F.sum(mixing.n_words()).alias("n"))
    plan = mixing.mix_sources(docs).where("taken > 0").select("doc_id", F.col("taken").alias("n"))
    assert sorted(map(tuple, words.collect())) == sorted(map(tuple, plan.collect()))


URLS = [
    ("http://A.Example.com/en/1", "a.example.com", "/en/1", "example.com/en/", "block"), ("https://www.EXAMPLE.com/en/x?q#f", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
    ("http://x.com", "x.com", "", None, "allow"), ("http://x.com?a/b", "x.com", "", None, "allow"), ("http://x.com#z", "x.com", "", None, "allow"), ("http://x.com/", "x.com", "/", "com/", "allow"),
    ("http://y.net/es/1/", "y.net", "/es/1/", "net/es/", "block"), ("http://notcom/en/", "notcom", "/en/", None, "allow"), ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
    ("a://b://c/d", "b:", "//c/d", None, "allow"), ("http://xexample.com/en/1", "xexample.com", "/en/1", "com/", "allow"),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u[0], "x", "y") for i, u in enumerate(URLS)], "page_id bigint, url string, host string, path string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(pages).collect()}
    assert got == {i: u[1:] for i, u in enumerate(URLS)}
    assert url_filter.url_filter(pages.limit(0)).count() == 0
    assert url_filter.url_filter(pages, rules=()).where("verdict = 'allow' and rule is null").count() == len(URLS)


def test_url_templates(spark):
    rows = [(i, f"http://bad.net/{lang}/{i}.html") for i in range(200) for lang in ("es", "fr")] + [(i, f"http://bad.net/de/{i}.html") for i in range(20)] + [(i, f"http://good.org/blog/{w}{i}") for i in range(50) for w in ("post-", "note-")]
    rows += [(i, f"http://slugs.org/" + "abcdefghijklmnopqrstuvwxyz"[i % 26] * (1 + i // 26)) for i in range(60)]
    got = url_filter.url_filter(spark.createDataFrame(rows, "page_id bigint, url string"))
    seen = {(r.host, r.template): r.verdict for r in got.select("host", "template", "verdict").distinct().collect()}
    assert seen[("bad.net", "/de/*.html")] == "block" and seen[("slugs.org", "/*")] == "allow" and seen[("good.org", "/blog/*")] == "allow"


def plain_purity(rows, depth, z=1.96, strength=8.0):
    """host, template -> purity for rows (host, template without wildcards to find, n_labelled, n_block), node by node."""

    def total(keep):
        chosen = [r for r in rows if keep(r)]
        return sum(r[3] for r in chosen), sum(r[2] for r in chosen)

    def node(r, level):
        return r[0], "/".join(r[1].split("/")[: level + 1])

    def alike(k, n, kp, n_p):
        share = kp / n_p if n_p else 0.0
        return n == 0 or abs(k / n - share) <= z * math.sqrt(share * (1 - share) * (1 / n + 1 / n_p))

    k, n = total(lambda r: True)
    prior, out = min(k / n if n else 0.0, 0.5), {}
    for row in rows:
        kp, n_p = total(lambda r: r[0] == row[0])
        above = (kp + strength * prior) / (n_p + strength)
        for level in range(1, depth + 1):
            children = {node(r, level): total(lambda x: node(x, level) == node(r, level)) for r in rows if node(r, level - 1) == node(row, level - 1)}
            mine = children[node(row, level)]
            same = [c for c in children.values() if alike(*c, kp, n_p)]
            k, n = map(sum, zip(*same)) if alike(*mine, kp, n_p) else mine
            above = (k + strength * above) / (n + strength)
            kp, n_p = mine
        k, n = total(lambda r: r[:2] == row[:2])
        out[row[:2]] = (k + strength * above) / (n + strength)
    return out


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_siblings_merge_at_every_level(spark, depth):
    rng, rows = random.Random(depth), []
    for host in ("a.org", "b.org"):
        for a, b, c in itertools.product("pq", "xyz", "uvw"):
            n = rng.choice([0, 0, 3, 40])
            rows.append((host, f"/{a}/{b}/{c}"[: 2 * depth], n, min(n, rng.choice([0, n, n // 2]))))
    rows = [(h, t, sum(r[2] for r in rows if r[:2] == (h, t)), sum(r[3] for r in rows if r[:2] == (h, t))) for h, t in sorted({r[:2] for r in rows})]
    shapes = spark.createDataFrame([(h, t, max(1, n), n, k) for h, t, n, k in rows], "host string, shape string, n bigint, n_labelled bigint, n_block bigint")
    got = url_filter.template_purity(url_filter.template_tree(shapes, depth=depth), depth=depth).collect()
    want = plain_purity(rows, depth)
    assert {(r.host, r.template) for r in got} == set(want) and all(abs(r.purity - want[r.host, r.template]) < 1e-12 for r in got)
    assert len(set(want.values())) > 2


def test_deep_rules_reach_their_siblings(spark):
    """Below /docs one child is blocked, one allowed: another child follows neither, and a deeper one its own parent."""
    rows = [f"http://s.org/docs/spam/ads/{i}.html" for i in range(60)] + [f"http://s.org/docs/good/ads/{i}.html" for i in range(60)] + ["http://s.org/docs/new/ads/1.html", "http://s.org/docs/spam/ads2", "http://s.org/docs/good/else/1.html"]
    rules = (("block", "s.org", "/docs/spam/ads/"), ("allow", "s.org", "/docs/good/ads/"))
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id bigint, url string")
    got = {r.path: (r.verdict, r.purity) for r in url_filter.url_filter(pages, rules=rules).where("rule is null").collect()}
    assert {p: v for p, (v, _) in got.items()} == {"/docs/new/ads/1.html": "allow", "/docs/spam/ads2": "block", "/docs/good/else/1.html": "allow"}
    assert abs(got["/docs/new/ads/1.html"][1] - 0.5) < 1e-12 and got["/docs/good/else/1.html"][1] < 0.1
