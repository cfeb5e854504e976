"""A training-data pipeline over ``documents``: filter, deduplicate, mix, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next stage's ``docs``; all but the last keep the columns of ``documents``. Labels for the two classifiers come
from ``labels`` and are learnt from the same rows as in the operators' own queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termlens.llm import jaccard_join, mixing, quality_classifier, sentencepiece_codec, toxicity
from termlens.llm.common import crc_bucket, table, written
from termlens.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "quality", crc_bucket("doc_id", 4) != 2)
    return quality_classifier.scored(docs, model, "text").where("predicted = 1").select(docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "toxic", crc_bucket("doc_id", 5) != 0)
    return toxicity.scored(docs, model, "text").where("predicted = 0").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (5-word shingles, Jaccard similarity of 0.8 or more)."""
    return jaccard_join.representatives(docs, "doc_id", "text", n=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's documents: what is taken of a document, with its white space, one row per epoch in which words of it are taken."""
    return mixing.mixed_documents(docs, "doc_id", "text", "source", "n_chars")


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document of the mix."""
    with open(tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    return sentencepiece_codec.encoded(docs, "text", model).select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [
    ("quality classifier", quality),
    ("toxicity", toxic),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources", mix),
    ("SentencePiece encoding", pieces),
]
ORACLE_SQL = None  # the classifiers' fits are not expressible in SQL; tests compare with plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
