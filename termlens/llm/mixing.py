"""Operator 2: mixing sources to target weights, in words.

Every source's words, document after document in id order, are packed into blocks of ``BLOCK`` words (the last
one may be shorter). Output shards of ``SHARD`` slots draw multinomial source counts; a source's slots are
numbered through the shards and mapped to its blocks by one pseudorandom permutation of the block index per
epoch, so no block comes a second time before all came once. Slots and blocks are joined by (source, index):
distinct keys, so a hot source is spread like any other.

The draws of a source differ from its quota (target / block size) by about the root of it. Slots drawn beyond
a quota are dealt, by index, to the slot numbers other sources still lack, so every source gets its quota
exactly; targets never exceed ``MOST`` times a source's size, so no block is taken more than ``MOST`` times.

Targets: sources in code point order, null last, weigh 5, 2, 1, repeating, and share the sum of all sizes;
where a share exceeds ``MOST`` times the source's size it stops there, and the excess is shared again by
weight among the others until none is above.

Defined cases: null and empty texts have size 0 and are never taken; a null source is a source of its own;
a null id sorts last; repeated rows are packed each; an empty table gives an empty mix. Reruns agree: all
draws and permutations are keyed by ``seed``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termlens.llm.common import mixed, numbered, word_slices, words, written

BLOCK = 64  # words a block
SHARD = 1024  # slots a shard
MOST = 3
WEIGHTS = (5, 2, 1)


def source_targets(sizes: DataFrame, most: int = MOST, weights=WEIGHTS) -> DataFrame:
    """(source, source_size) -> adds source_no (0-based rank), weight and target.

    Water filling on the table of sources: with r = most * size / weight, a level L caps the sources with
    r <= L; L rises from "none capped" until it stays, at most once per source, in practice a few times."""
    ranked = numbered(sizes, [], ["source"], name="mix-sources").withColumnRenamed("before", "source_no")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    rows = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * most)
    level = 0.0
    while True:
        capped = F.col("cap") <= F.lit(level) * F.col("weight")
        got = rows.agg(F.sum("source_size").alias("all"), F.sum(F.when(capped, F.col("cap"))).alias("capped"),
                       F.sum(F.when(~capped, F.col("weight"))).alias("open")).first()
        if not got["all"] or not got["open"]:
            break
        raised = (got["all"] - (got["capped"] or 0.0)) / got["open"]
        if raised <= level * (1 + 1e-12):
            break
        level = raised
    return rows.withColumn("target", F.least("cap", F.lit(level) * F.col("weight"))).drop("cap")


def _feistel(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of 0..n-1, element by element: four Feistel rounds over the next even power of
    two, walked on until the value is below n."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    value, todo = index.astype(np.uint64), np.ones(len(index), dtype=bool)
    while todo.any():
        left, right, h, m, k = value[todo] >> half[todo], value[todo] & mask[todo], half[todo], mask[todo], key[todo]
        for r in range(4):
            left, right = right, left ^ (mixed(right + k * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r + 1)) & m)
        value[todo] = (left << h) | right
        todo &= value >= n.astype(np.uint64)
    return value.astype(np.int64)


def _draws(chances: np.ndarray, slots: int, seed: int):
    def run(frames):
        for shards in frames:
            for shard in shards["id"]:
                n = min(SHARD, slots - int(shard) * SHARD)
                counts = np.random.default_rng([seed, int(shard)]).multinomial(n, chances)
                yield pd.DataFrame({"shard": int(shard), "source_no": np.flatnonzero(counts), "n": counts[counts > 0]})
    return run


def pieces(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """(packed documents, sources). Packed documents keep all columns and get ``size``, ``source_no`` and
    ``before``, the number of words ahead of them in their source; sources have sizes and targets.

    ``docs`` may have any further columns; the added names start with ``mix_`` or are replaced."""
    sized = docs.withColumn("size", F.size(words(F.col(text_col))).cast("long")).withColumn("mix_tie", F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    placed = numbered(sized, [source_col], [id_col, "mix_tie"], value="size", name="mix-docs").drop("mix_tie")
    sizes = placed.groupBy(F.col(source_col).alias("source")).agg(F.sum("size").alias("source_size"))
    sources = written(source_targets(sizes)
                      .withColumn("blocks", F.ceil(F.col("source_size") / BLOCK).cast("long"))
                      .withColumn("slots", F.when(F.col("source_size") > 0, F.least(
                          F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"), F.col("blocks") * MOST)).otherwise(F.lit(0).cast("long"))),
                      "mix-targets")
    return placed, sources


def slots(sources: DataFrame, seed: int) -> DataFrame:
    """(shard, source_no, epoch, block): one row per slot of the mix.

    The driver holds one small row per source; shards, draws and slots are made by tasks."""
    spark = sources.sparkSession
    quota = sources.where("slots > 0").select("source_no", "slots", "blocks").orderBy("source_no").toPandas()
    total = int(quota.slots.sum()) if len(quota) else 0
    chances = np.zeros(int(quota.source_no.max()) + 1 if len(quota) else 1)
    if total:
        chances[quota.source_no.to_numpy()] = quota.slots.to_numpy() / total
    drawn = written(spark.range(-(-total // SHARD)).mapInPandas(_draws(chances, total, seed), "shard long, source_no long, n long"), "mix-draws")
    counted = numbered(drawn, ["source_no"], ["shard"], value="n", name="mix-shards")
    slot = counted.select("shard", "source_no", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("n") - 1)).alias("t"))
    got = drawn.groupBy("source_no").agg(F.sum("n").alias("got"))
    plan = (sources.where("slots > 0").join(got, "source_no", "left").fillna(0, ["got"])
            .select("source_no", "slots", "blocks", "got", F.greatest(F.col("got") - F.col("slots"), F.lit(0)).alias("over"),
                    F.greatest(F.col("slots") - F.col("got"), F.lit(0)).alias("under")))
    plan = numbered(numbered(plan, [], ["source_no"], value="over", name="mix-over").withColumnRenamed("before", "over_at"),
                    [], ["source_no"], value="under", name="mix-under").withColumnRenamed("before", "under_at")
    full = slot.join(plan.select("source_no", "slots", "over_at"), "source_no")
    spare = full.where("t >= slots").select("shard", (F.col("over_at") + F.col("t") - F.col("slots")).alias("u"))
    lacking = plan.where("under > 0").select(
        F.col("source_no"), "got", "under_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("under") - 1)).alias("j"))
    dealt = spare.join(lacking.select((F.col("under_at") + F.col("j")).alias("u"), "source_no", (F.col("got") + F.col("j")).alias("t")), "u")
    every = (full.where("t < slots").select("shard", "source_no", "t").unionByName(dealt.select("shard", "source_no", "t"))
             .join(plan.select("source_no", "blocks"), "source_no"))

    @F.pandas_udf(T.LongType())
    def block(source_no: pd.Series, t: pd.Series, n: pd.Series) -> pd.Series:
        s, t, n = (x.to_numpy(dtype=np.int64) for x in (source_no, t, n))
        key = mixed((np.uint64(seed) << np.uint64(32)) ^ (s.astype(np.uint64) << np.uint64(8)) ^ (t // n).astype(np.uint64))
        return pd.Series(_feistel(t % n, n, key))

    return every.select("shard", "source_no", F.floor(F.col("t") / F.col("blocks")).alias("epoch"), block("source_no", "t", "blocks").alias("block"))


def mix(placed: DataFrame, sources: DataFrame, source_col: str, seed: int = 1) -> DataFrame:
    """(shard, source_no, epoch, block, before, from_word, n_words): the spans of documents that the mix takes;
    ``before`` names the document within its source."""
    first = F.floor(F.col("before") / BLOCK)
    last = F.floor((F.col("before") + F.col("size") - 1) / BLOCK)
    at = placed.where("size > 0").join(sources.select(F.col("source").alias("mix_source"), "source_no"),
                                       F.col(source_col).eqNullSafe(F.col("mix_source")))
    cut = at.select("source_no", "before", "size", F.explode(F.sequence(first, last)).alias("block"))
    start = F.greatest(F.col("block") * BLOCK - F.col("before"), F.lit(0))
    spans = cut.select("source_no", "block", "before", start.alias("from_word"),
                       (F.least((F.col("block") + 1) * BLOCK - F.col("before"), F.col("size")) - start).alias("n_words"))
    return slots(sources, seed).join(spans, ["source_no", "block"])


def taken(placed: DataFrame, mixture: DataFrame, sources: DataFrame, source_col: str) -> DataFrame:
    """``placed`` with source_no, source_size, target and ``taken``, the words the mix takes of each document."""
    sums = mixture.groupBy("source_no", F.col("before").alias("mix_before")).agg(F.sum("n_words").alias("taken"))
    named = sources.select(F.col("source").alias("mix_source"), "source_no", "source_size", "target")
    at = placed.join(named, F.col(source_col).eqNullSafe(F.col("mix_source"))).drop("mix_source")
    sums = sums.withColumnRenamed("source_no", "mix_no")
    return (at.join(sums, (F.col("source_no") == F.col("mix_no")) & (F.col("before") == F.col("mix_before")) & (F.col("size") > 0), "left")
            .drop("mix_no", "mix_before").fillna(0, ["taken"]))


def mixed_documents(docs: DataFrame, id_col: str, text_col: str, source_col: str, length_col: str | None = None, seed: int = 1) -> DataFrame:
    """The mix as documents, in the columns of ``docs``: one row per document and epoch in which words of it are
    taken (so a document may come up to ``MOST`` times, whole or in part). The text is the taken slices of the
    original in order, each a word with the white space behind it (the first also with that ahead): a document
    taken whole comes out unchanged. ``length_col`` is set to the new text's length."""
    placed, sources = pieces(docs, id_col, text_col, source_col)
    spans = mix(placed, sources, source_col, seed)
    copies = (spans.groupBy(F.col("source_no").alias("mix_no"), F.col("before").alias("mix_before"), F.col("epoch").alias("mix_epoch"))
              .agg(F.sort_array(F.collect_list(F.struct("from_word", "n_words"))).alias("mix_spans")))  # bounded by one document's words
    named = sources.select(F.col("source").alias("mix_source"), "source_no")
    at = placed.where("size > 0").join(named, F.col(source_col).eqNullSafe(F.col("mix_source"))).drop("mix_source")
    rows = at.join(copies, (F.col("source_no") == F.col("mix_no")) & (F.col("before") == F.col("mix_before")))
    # the slices are bound once for all spans; as a column of their own they would be cut again for each span
    chosen = F.element_at(F.transform(F.array(word_slices(F.col(text_col))), lambda w: F.array_join(F.flatten(
        F.transform("mix_spans", lambda s: F.slice(w, (s.from_word + 1).cast("int"), s.n_words.cast("int")))), "")), 1)
    rows = rows.withColumn(text_col, chosen)
    if length_col:
        rows = rows.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return rows.select(docs.columns)
