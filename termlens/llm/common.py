"""Shared helpers: table access, shared scratch tables, ids and word rules."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from termlens.session import checkpoint_dir
from termlens.sources.tables import read_table

# ---- fixed values: a word is a run of bytes other than ASCII white space; A-Z are lower-cased ----
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# ---------------------------------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def crc_bucket(column, buckets: int):
    """crc32 of the id as text, modulo ``buckets``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % buckets


def lower_ascii(column):
    return F.translate(column, UPPER, UPPER.lower())


def words(column):
    """Array of the words of a text (null: none)."""
    return F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit("(" + WORD + ")"), 1)


def word_slices(column):
    """Array of the text cut at word bounds, one slice a word of ``words``: the word with the white space behind
    it, the first also with that ahead. Joined by the empty string they are the text (without words: none)."""
    return F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit(rf"((?:\A{SPACES}+)?{WORD}{SPACES}*)"), 1)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back: a lost executor then
    costs a read, and two plans over the result see the same rows."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def squeeze(values: np.ndarray) -> bytes:
    """An array as compressed bytes: 8 bytes of length, then zstd over byte planes."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unsqueeze(data: bytes, dtype) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    if not size:
        return np.zeros(0, dtype)
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(dtype).reshape(-1)


def portions(texts, size: int = 2 << 20):
    """Consecutive pieces of a list of texts of about ``size`` letters each, to bound what a task holds."""
    lo = total = 0
    for hi, text in enumerate(texts):
        total += len(text or "") + 1
        if total >= size:
            yield texts[lo:hi + 1]
            lo, total = hi + 1, 0
    if lo < len(texts):
        yield texts[lo:]


def mixed(keys: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: spreads integer keys over 64 bits."""
    x = np.asarray(keys).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_M = 0x9E3779B97F4A7C15 | 1
_M_INVERSE = pow(_M, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
        np.cumprod(out, out=out)
    return out


def span_hashes(stream: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``stream[starts[i]:ends[i]]``: polynomial over scrambled bytes, from prefix sums."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    letters = mixed(np.arange(256, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(0x2545F4914F6CDD1D))
    sums = np.zeros(len(stream) + 1, dtype=np.uint64)
    np.cumsum(letters[stream] * _powers(_M, len(stream)), out=sums[1:])
    value = (sums[ends] - sums[starts]) * _powers(_M_INVERSE, len(stream) + 1)[starts]
    return mixed(value ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))


def numbered(df: DataFrame, group: list, order: list, value=None, name: str = "numbered") -> DataFrame:
    """Adds ``before``: the sum of ``value`` (default 1: the row's 0-based rank) over the earlier rows of its
    group. ``group`` and ``order`` are column names. Two levels, so that a hot group is spread: rows are range
    partitioned by group and order and written; sums per (piece, group) give each piece its offset; windows
    run inside a piece. Rows equal in ``group`` and ``order`` are interchangeable."""
    spark = df.sparkSession
    df = df.withColumn("__v", F.lit(1).cast("long") if value is None else F.col(value).cast("long"))
    keys = [*group, *order]
    pieces = df.repartitionByRange(*[F.col(c).asc_nulls_last() for c in keys]) if keys else df
    pieces = written(pieces.withColumn("__p", F.spark_partition_id()), name)
    names = [f"__g{i}" for i in range(len(group))]
    sums = pieces.groupBy("__p", *[F.col(c).alias(n) for c, n in zip(group, names)]).agg(F.sum("__v").alias("__s"))
    offsets = sums.withColumn("__o", F.coalesce(F.sum("__s").over(
        Window.partitionBy(*names).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__s")
    same = [pieces["__p"] == offsets["__p"], *[pieces[c].eqNullSafe(offsets[n]) for c, n in zip(group, names)]]
    joined = pieces.join(offsets, same).drop(offsets["__p"]).drop(*names)
    inside = F.sum("__v").over(Window.partitionBy("__p", *group).orderBy(*[F.col(c).asc_nulls_last() for c in order])
                               .rowsBetween(Window.unboundedPreceding, -1))
    return joined.withColumn("before", F.col("__o") + F.coalesce(inside, F.lit(0))).drop("__v", "__p", "__o")


def tree_sum(df: DataFrame, fan: int = 24) -> np.ndarray | None:
    """Sum of the equally long float64 vectors in column ``v`` (binary), ``fan`` at a time, so that no task
    holds more than ``fan`` of them; None without rows."""
    import pandas as pd

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(rows.v.iloc[0], np.float64).copy()
        for x in rows.v.iloc[1:]:
            total += np.frombuffer(x, np.float64)
        return pd.DataFrame({"v": [total.tobytes()]})

    parts = df.rdd.getNumPartitions()
    df = df.select("v", F.spark_partition_id().alias("k"))
    while parts > 1:
        parts = -(-parts // fan)
        df = (df.groupBy(F.floor(F.col("k") / fan).alias("k")).applyInPandas(
            lambda key, rows: add(rows).assign(k=key[0]), "v binary, k long"))
    rows = df.collect()
    return sum((np.frombuffer(r.v, np.float64) for r in rows[1:]), np.frombuffer(rows[0].v, np.float64).copy()) if rows else None


LINKS_PER_TASK = 1 << 16


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over ``links``, for every node that has one.

    Alternating large-star and small-star steps (each a grouped minimum and a join, so a hot node is
    pre-aggregated and split); every step is written to the shared folder. Stops when all links lead straight
    to a component's smallest node. A step has many exchanges: behind each, partitions are put together to as many tasks as the
    links ask for, so that few links cost few files and tasks, whatever the session's number of partitions."""
    cores = links.sparkSession.sparkContext.defaultParallelism
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    few = lambda d: d.coalesce(tasks)  # noqa: E731 - merges partitions, deals nothing out
    tasks = max(cores, -(-links.count() // LINKS_PER_TASK))
    edges = written(few(few(links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b")).distinct()), "cc-links")
    while True:
        tasks = max(cores, -(-edges.count() // LINKS_PER_TASK))
        every = few(both(edges))
        low = few(every.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = few(few(every.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").where("a <> b")).distinct())
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))  # every node's smaller neighbours
        least = few(down.groupBy("u").agg(F.min("v").alias("m")))
        small = few(few(down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b"))
                    .unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))).distinct()
        edges = written(few(small), "cc-step")
        # done when every larger end has one link, and no smaller end is itself a larger one
        many = few(edges).groupBy("b").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        if not many and not few(edges).select(F.col("a").alias("b")).join(few(edges).select("b"), "b", "left_semi").limit(1).count():
            break
    return few(edges).select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        few(few(edges).select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()))
