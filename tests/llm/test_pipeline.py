"""The pipeline's stages, each on what the one before it kept."""

from pyspark.sql import functions as F

import corpus_pipeline as P
from motifloom.llm import exact_dedup, mixing, ngram_join, toxicity
from motifloom.llm.common import written
from tests.llm.test_ngram_join import brute


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "mixing sources", "best-fit packing"]
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    one = P.toxicity(spark, docs, sf_dir)
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels))
    assert one.columns == docs.columns and ids(one) == ids(scored.where("predicted = 0"))
    two = P.exact_duplicates(spark, one, sf_dir)
    last = {}
    for r in one.collect():
        last[r.text] = max(r.doc_id, last.get(r.text, -1))
    assert two.columns == docs.columns and ids(two) == sorted(last.values())
    three = P.near_duplicates(spark, two, sf_dir)
    want = brute([(r.doc_id, r.text) for r in two.collect()], 5, 80, 100)
    assert three.columns == docs.columns and ids(three) == sorted(d for d, (_, c) in want.items() if c == d)
    four = P.mixing(spark, three, sf_dir)
    assert four.columns == docs.columns and set(ids(four)) <= set(ids(three))
    five = P.packing(spark, four, sf_dir)
    assert set(ids(five)) == set(ids(four)) and five.where("length > 2048").count() == 0
    assert all(m.__name__ for m in (exact_dedup, mixing, ngram_join))


def test_stages_take_edges(spark, sf_dir, edge_docs):
    """Nulls, empty and long texts, ties, repeated rows and clashing names: what each stage's docstring says."""
    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=lambda x: (x is not None, x))
    every = [None, None, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]
    one = P.toxicity(spark, edge_docs, sf_dir)
    assert one.columns == edge_docs.columns and ids(one) == every
    two = written(P.exact_duplicates(spark, edge_docs, sf_dir), "test")
    assert two.columns == edge_docs.columns and ids(two) == [None, 2, 4, 5, 6, 7, 8, 9, 10, 11]
    three = written(P.near_duplicates(spark, two, sf_dir), "test")
    assert three.columns == edge_docs.columns and ids(three) == [None, 2, 4, 5, 6, 8, 10, 11]
    four = written(P.mixing(spark, edge_docs, sf_dir), "test")
    assert four.columns == edge_docs.columns and not {3, 4, 5} & set(ids(four))
    words = lambda df: df.agg(F.sum(mixing.n_words())).first()[0]
    assert words(four) == sum(r.taken for r in mixing.mix_sources(edge_docs).collect())
    five = P.packing(spark, three, sf_dir).collect()
    assert sorted({r.doc_id for r in five if r.doc_id is not None}) == [2, 4, 5, 6, 8, 10, 11] and max(r.length for r in five) <= 2048
    assert [r.length for r in five if r.doc_id == 4] == [1]
    some = edge_docs.limit(0)
    for _, stage in P.STAGES:
        some = stage(spark, some, sf_dir)
        assert some.count() == 0
