"""Segment vectors -> one vector per sample (G1-G8), as grouped aggregations.

Sums, means and maxima are one array aggregate (Spark ML's ``Summarizer``) whatever the width: it is partial-aggregated
map-side, so a sample with many segments never travels as one list, and needs a single exchange by _id. No job runs
while the plan is built, and the plan does not grow with the width.

Segments without a vector (null) are left out, of the label and of ``n_segments`` as well; widths that differ within a
sample raise.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlens.functions import arrays as ar


def segments_from_embeddings(emb: DataFrame, per_sample: int = 5) -> DataFrame:
    """Binding of the supplied ``embeddings`` table: ``_id = vec_id div n``, ``segment = vec_id % n``."""
    return emb.select((F.col("vec_id") / per_sample).cast("bigint").alias("_id"),
                      (F.col("vec_id") % per_sample).cast("int").alias("segment"),
                      F.transform("embedding", lambda v: v.cast("double")).alias("embedding"),
                      F.col("label").cast("int").alias("label"))


# method -> statistics whose vectors are put one behind the other
STATISTICS = {"avg_pool": ["mean"], "avgmax_pool": ["mean", "max"], "avgmaxnorm_pool": ["mean", "max"],
              "norm": ["sum"], "norm_sum_pool": ["sum"]}


def pool(segments: DataFrame, method: str, digits: int | None = 9) -> DataFrame:
    """``(_id, label, n_segments, embedding)`` pooled with ``avg_pool``, ``avgmax_pool``,
    ``avgmaxnorm_pool``, ``norm``, ``norm_sum_pool`` or ``first``."""
    if method != "first" and method not in STATISTICS:
        raise ValueError(f"unknown pooling {method!r}")
    label = F.min_by("label", "segment").alias("label")  # G8: label of the first segment
    n = F.count(F.lit(1)).alias("n_segments")
    groups = segments.where(F.col("embedding").isNotNull()).groupBy("_id")
    if method == "first":
        out = groups.agg(label, n, F.min_by("embedding", "segment").alias("embedding"))
    else:
        names = STATISTICS[method]
        stats = Summarizer.metrics(*names).summary(array_to_vector("embedding")).alias("_stats")
        parts = [vector_to_array(F.col("_stats")[name]) for name in names]
        out = groups.agg(label, n, stats).select("_id", "label", "n_segments", F.concat(*parts).alias("embedding"))
        if method in ("avgmaxnorm_pool", "norm"):
            out = ar.with_layer_norm(out, "embedding", "embedding")
        elif method == "norm_sum_pool":
            out = out.withColumn("embedding", ar.normed_sum("embedding"))
    if digits is not None:
        out = out.withColumn("embedding", ar.round_all("embedding", digits))
    return out


def dedupe_labels(segments: DataFrame) -> DataFrame:
    """One label row per sample (the first segment's)."""
    return segments.groupBy("_id").agg(F.min_by("label", "segment").alias("label"))


def attention_scores(attn: DataFrame, layer_head: int = -1) -> DataFrame:
    """Token score = mean over layers of the last head's attention to key 0, from a table
    ``(_id, segment, layer, head, query, key, score)``."""
    last = attn.agg(F.max("head").alias("_h")) if layer_head == -1 else None
    df = attn.crossJoin(F.broadcast(last)).where(F.col("head") == F.col("_h")) if last is not None \
        else attn.where(F.col("head") == layer_head)
    return (df.where(F.col("key") == 0).groupBy("_id", "segment", "query")
            .agg(F.avg("score").alias("attr")).withColumnRenamed("query", "pos"))
