"""Dataset preparation (P1-P13): encode, index, split, sample, skip.

Row indices are numbered by ranges, and stratified selection by counts of hash buckets: no window is keyed by nothing or
by a label alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termlens.operators.numbering import with_position


def class_encode(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Sorted distinct values -> 0..k-1 (distributed index of the sorted distinct set); a null
    value keeps a null code."""
    out = out or f"{column}_id"
    values = df.select(column).distinct().where(F.col(column).isNotNull())
    codes = row_index(values, column, "_code").select(column, F.col("_code").cast("int").alias(out))
    return df.join(codes, column, "left")


def row_index(df: DataFrame, order_col: str, out: str = "row_idx") -> DataFrame:
    """0-based index in ``order_col`` order."""
    return with_position(df, [], [F.col(order_col).asc()], out)


def ordered_split(df: DataFrame, order_col: str, test_size: float = 0.5) -> DataFrame:
    """Unshuffled split: the first ``n - ceil(test_size * n)`` rows are train, the rest test."""
    idx = row_index(df, order_col)
    n = idx.agg(F.count(F.lit(1)).alias("_n"))
    return (idx.crossJoin(F.broadcast(n))
            .withColumn("split", F.when(F.col("row_idx") < F.col("_n") - F.ceil(F.col("_n") * test_size), "train")
                        .otherwise("test")).drop("_n"))


def _hash_order(id_col: str, seed: int):
    return F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))))


BUCKET_DIGITS = 4  # leading hex digits of the hash: at most 65,536 buckets a label


def _cuts(df: DataFrame, id_col: str, label_col: str, seed: int, wanted: DataFrame | None, fraction: float | None) -> DataFrame:
    """``(_label, _bucket, _k)`` per label: the bucket in which the last wanted row lies, and how many of its rows are
    wanted; all of the buckets ahead of it are. ``wanted(_label, _want)`` or a rounded ``fraction`` of a label's rows."""
    counts = df.groupBy(F.col(label_col).alias("_label"), F.substring(_hash_order(id_col, seed), 1, BUCKET_DIGITS).alias("_b")).agg(
        F.count(F.lit(1)).alias("_n"))
    per = counts.groupBy("_label").agg(F.sort_array(F.collect_list(F.struct("_b", "_n"))).alias("_bs"), F.sum("_n").alias("_c"))
    if wanted is None:
        per = per.withColumn("_want", F.round(F.col("_c") * fraction).cast("long"))
    else:
        per = per.join(F.broadcast(wanted.withColumnRenamed("_label", "_l")), F.col("_label").eqNullSafe(F.col("_l"))).drop("_l")
    zero = F.struct(F.lit(0).cast("long").alias("seen"), F.lit("").alias("b"), F.lit(0).cast("long").alias("k"))

    def step(acc, e):
        return F.when(acc["seen"] < F.col("_want"), F.struct(
            (acc["seen"] + e["_n"]).alias("seen"), e["_b"].alias("b"), (F.col("_want") - acc["seen"]).alias("k"))).otherwise(acc)

    return per.select("_label", F.aggregate("_bs", zero, step).alias("_at")).select("_label", F.col("_at.b").alias("_bucket"), F.col("_at.k").alias("_k"))


def _chosen(df: DataFrame, id_col: str, label_col: str, seed: int, cuts: DataFrame) -> DataFrame:
    """``df`` with ``_in``: the row is among its label's wanted ones in hash order. Only the rows of a label's last bucket
    are ranked. ``cuts`` has a row per label and is broadcast, as a code table is."""
    h = _hash_order(id_col, seed)
    j = (df.join(F.broadcast(cuts), F.col(label_col).eqNullSafe(F.col("_label")))
         .withColumn("_h", h).withColumn("_b", F.substring("_h", 1, BUCKET_DIGITS)))
    edge = Window.partitionBy(label_col, "_b").orderBy("_h", id_col)
    ranked = j.where(F.col("_b") == F.col("_bucket")).withColumn("_in", F.row_number().over(edge) <= F.col("_k"))
    clear = j.where(F.col("_b") != F.col("_bucket")).withColumn("_in", F.col("_b") < F.col("_bucket"))
    return clear.unionByName(ranked).select(*df.columns, "_in")


def stratified_split(df: DataFrame, id_col: str, label_col: str, fraction: float = 0.1, seed: int = 0,
                     name: str = "eval", rest: str = "train") -> DataFrame:
    """P5: per label, the first ``round(fraction * count)`` rows in md5(id, seed) order go to ``name``; rows are ordered by
    a hash, so the split is repeatable under retries."""
    cuts = _cuts(df, id_col, label_col, seed, None, fraction)
    return _chosen(df, id_col, label_col, seed, cuts).withColumn("split", F.when(F.col("_in"), name).otherwise(rest)).drop("_in")


def stratified_sample(df: DataFrame, id_col: str, label_col: str, n: int, seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows (or all when fewer), allocated to labels by largest remainder of
    ``n * count / total`` (ties to the smaller label), each stratum in md5(id, seed) order."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("_c"))
    total = counts.agg(F.sum("_c").alias("_t"))
    q = counts.crossJoin(F.broadcast(total)).withColumn("_exact", F.col("_c") * F.lit(n) / F.col("_t"))
    q = q.withColumn("_base", F.floor("_exact").cast("long")).withColumn("_frac", F.col("_exact") - F.col("_base"))
    left = q.agg((F.lit(n) - F.sum("_base")).alias("_left"))
    rw = Window.orderBy(F.col("_frac").desc(), F.col(label_col).asc())  # one row per label: tiny
    alloc = (q.crossJoin(F.broadcast(left)).withColumn("_r", F.row_number().over(rw))
             .select(F.col(label_col).alias("_label"), F.least(F.col("_c"), F.col("_base") + F.when(F.col("_r") <= F.col("_left"), 1)
                                                               .otherwise(0)).cast("long").alias("_want")))
    return _chosen(df, id_col, label_col, seed, _cuts(df, id_col, label_col, seed, alloc, None)).where("_in").drop("_in")


def skip_done(todo: DataFrame, done: DataFrame, id_col: str = "_id") -> DataFrame:
    """Keep rows whose id has no output yet (anti join)."""
    return todo.join(done.select(id_col).distinct(), id_col, "left_anti")


def keep_ids(df: DataFrame, ids: DataFrame, id_col: str = "_id") -> DataFrame:
    """Keep the given ids (semi join)."""
    return df.join(ids.select(id_col).distinct(), id_col, "left_semi")


def dev_limit(df: DataFrame, order_col: str, n: int = 100) -> DataFrame:
    """The first n rows in a defined order (a limit is the feature here)."""
    return df.orderBy(order_col).limit(n)


def max_segments(df: DataFrame, segments_col: str, limit: int = 5) -> DataFrame:
    """Skip samples with more than ``limit`` segments."""
    return df.where(F.size(segments_col) <= limit)


def with_errors(df: DataFrame, ok, message: str):
    """Split rows into (kept, rejects) by a condition column; rejects carry an ``error`` message
    instead of stopping the job."""
    kept = df.where(ok)
    rejects = df.where(~ok).withColumn("error", F.lit(message))
    return kept, rejects


# Named row-processing functions (never ``eval``)
PROCESS_FUNCTIONS = {}


def process_function(name: str):
    def deco(fn):
        PROCESS_FUNCTIONS[name] = fn
        return fn
    return deco


@process_function("truncate_512")
def _truncate_512(df: DataFrame) -> DataFrame:
    from termlens.functions import text as tx
    return df.withColumn("tokens", tx.truncate_tokens(tx.words("text"), 512))


@process_function("max_len_200")
def _max_len_200(df: DataFrame) -> DataFrame:
    from termlens.functions import text as tx
    return df.withColumn("tokens", tx.truncate_tokens(tx.words("text"), 200))


def apply_process(df: DataFrame, name: str) -> DataFrame:
    try:
        return PROCESS_FUNCTIONS[name](df)
    except KeyError:
        raise ValueError(f"unknown process function {name!r}; choose from {sorted(PROCESS_FUNCTIONS)}") from None
