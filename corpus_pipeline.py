"""A corpus pipeline: documents to packed training sequences, each stage one operator of motifloom.llm.

Every stage takes all rows that the stage before it kept, as a written table, and gives rows with the columns of
documents, whatever else these are named; the last one gives the places of all pieces in the packed sequences. An empty
table gives an empty one at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifloom.llm import exact_dedup, ngram_join
from motifloom.llm.common import read, written
from motifloom.llm.mixing import mixed_documents
from motifloom.llm.packing import pack_documents
from motifloom.llm.toxicity import clean_documents, fit_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go: those that score one half or more, by a model fitted on the labelled ones among docs.

    Null and empty texts hold no words and stay. Repeated rows score alike, so all of them stay or go. Whole texts are
    read, however long. A null id only means that the row is never learnt from.
    """
    return clean_documents(docs, fit_toxicity(docs, read(spark, sf_dir, "labels")))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays.

    Null counts as the empty text, and a null id loses to any other. Of rows that repeat id and text the first one by
    their other columns stays. Whole texts are compared, however long.
    """
    return exact_dedup.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of at least 0.8 on five-word shingles connect, the one with the smallest id stays.

    Null and empty texts link with nothing and stay, and so do rows with a null id. Rows that repeat an id stand for one
    document: all of them stay or go. Texts of fewer than five words are one shingle.
    """
    return ngram_join.kept_documents(docs, words=5, num=80, den=100)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents repeat or end where budgets say so.

    Null and empty texts hold no words and go. A null source is a source of its own, the last one. Rows that repeat id,
    source and text share what the mix takes of them. Ties of the hash key go by id and size.
    """
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in the packed sequences: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset.

    A null or empty text is one piece, the end id. Every row is packed, also where rows repeat. Texts of more than one
    sequence are cut into pieces, none is dropped.
    """
    pieces, places = pack_documents(docs)
    rows = pieces.select("key", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return rows.join(places, "key").drop("key")


STAGES = [("toxicity", toxicity), ("exact dedup", exact_duplicates), ("n-gram Jaccard join", near_duplicates), ("mixing sources", mixing), ("best-fit packing", packing)]

#: The first stage is a trained classifier, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for nth, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if nth < len(STAGES):
            docs = written(docs, "stage-" + name.replace(" ", "-"))
    return docs
