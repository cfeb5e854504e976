"""Table scans (S1-S4) and the binding of the supplied tables to the reference's data model.

``samples`` = documents joined with labels; the split is a deterministic md5 bucket of ``_id``
(50 % train, 10 % eval, 40 % test), which any engine with ``md5`` reproduces.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termlens.config import DEFAULT_TASKS, TaskMap
from termlens.operators import bitfilter

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

TRAIN_BUCKETS = 50
EVAL_BUCKETS = 10


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str, fmt: str = "parquet", **options) -> DataFrame:
    """Read one table. Parquet by default; CSV/JSON accepted."""
    path = table_path(sf_dir, name) if fmt == "parquet" else os.path.join(sf_dir, name)
    return spark.read.format(fmt).options(**options).load(path)


def hash_bucket(id_col, buckets: int = 100):
    """Deterministic bucket 0..buckets-1 from the first 32 bits of md5(id)."""
    h = F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 8), 16, 10).cast("bigint")
    return F.pmod(h, F.lit(buckets))


def split_of(id_col: str = "_id"):
    b = hash_bucket(id_col)
    return (F.when(b < TRAIN_BUCKETS, F.lit("train"))
            .when(b < TRAIN_BUCKETS + EVAL_BUCKETS, F.lit("eval"))
            .otherwise(F.lit("test")))


def samples(spark: SparkSession, sf_dir: str, tasks: TaskMap = DEFAULT_TASKS,
            drop_empty: bool = False, n_parts: int | None = None, sizes: bool = False) -> DataFrame:
    """D1 ``samples(_id, text, lang, split, <task> ...)``; null text dropped (P7). With ``n_parts`` the texts are dealt out
    by ``_id`` to that many tasks, which AQE does not merge. With ``sizes``, ``n_bytes`` in place of ``text``: no text is shuffled."""
    docs = read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("_id"), "text", "lang")
    labels = read_table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("_id"), *[F.col(t).cast("int").alias(t) for t in tasks.names])
    # shuffle-hash join on _id (labels build the hash side): the result is hash-partitioned by _id, so
    # every later per-document aggregate (term counts, norms) runs without another exchange, and the
    # per-document text work is spread over all tasks even when the scan yields few splits.
    docs = docs.where(F.col("text").isNotNull())
    if sizes:
        docs = docs.select("_id", F.octet_length("text").alias("n_bytes"), "lang")
    if n_parts:
        # texts without a label are not shuffled, but for the few that pass the filter
        ids = labels.select(bitfilter.key_hash(F.col("_id").cast("string")).alias("h"))
        bits = bitfilter.n_bits(ids.count())
        docs = bitfilter.passing(docs, F.col("_id").cast("string"), bitfilter.chunks(ids, bits), bits).repartition(n_parts, "_id")
    out = docs.join(labels.hint("shuffle_hash"), "_id")
    if drop_empty:
        out = out.where(F.col("text") != "")
    return out.withColumn("split", split_of("_id"))


def split_sql(id_expr: str = "doc_id") -> str:
    """The same split in DuckDB SQL."""
    b = f"(('0x' || substr(md5(CAST({id_expr} AS VARCHAR)), 1, 8))::BIGINT % 100)"
    return (f"CASE WHEN {b} < {TRAIN_BUCKETS} THEN 'train' "
            f"WHEN {b} < {TRAIN_BUCKETS + EVAL_BUCKETS} THEN 'eval' ELSE 'test' END")


def load_ranked(spark: SparkSession, path: str) -> DataFrame:
    """Read a ranked-terms table; an ``_id`` column stored as a ``"1,2"`` string becomes
    ``array<bigint>``. Ordering is applied where it is consumed (ranks), not here."""
    df = spark.read.parquet(path)
    if "_id" in df.columns and dict(df.dtypes)["_id"] == "string":
        df = df.withColumn("_id", F.transform(F.split("_id", ","), lambda v: F.trim(v).cast("bigint")))
    return df


def union_splits(samples: DataFrame, splits=("train", "test")) -> DataFrame:
    """The union of several splits (``full_data``)."""
    return samples.where(F.col("split").isin(list(splits)))
