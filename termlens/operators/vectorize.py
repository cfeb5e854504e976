"""TF-IDF in long form (V1-V5): ``(_id, term, tf)`` -> vocabulary -> ``(_id, term, x)``.

Shuffles: term frequency by (_id, term) with map-side combine (a document's n-grams are produced
in one task, so the partial aggregate already dedups them); document frequency by term with
partial aggregation (hot terms are pre-aggregated before the exchange); the vocabulary join by
term (AQE turns it into a broadcast join when the vocabulary is small at run time and splits
skewed term partitions otherwise); the L2 norm is a per-document aggregate joined back on _id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termlens.functions import text as tx
from termlens.operators import bitfilter


def document_terms(samples: DataFrame, n_min: int = 1, n_max: int = 3, stopwords: bool = True,
                   id_col: str = "_id", text_col: str = "text", lang_col: str | None = "lang",
                   pattern: str = tx.WORD_PATTERN, keep: tuple[str, ...] = ()) -> DataFrame:
    """T2+T3 per document: ``(_id, keep..., terms array<string>)``; stop words removed before n-grams."""
    w = tx.words(text_col, pattern)
    if stopwords and lang_col is not None:
        w = tx.drop_stopwords(w, lang_col)
    # the word array is a column of its own: n-gram lambdas reference it many times, and the optimizer
    # keeps a non-trivial producer in its own projection instead of re-evaluating it per reference
    words = samples.select(F.col(id_col).alias("_id"), *keep, w.alias("_w"))
    return words.select("_id", *keep, tx.ngrams("_w", n_min, n_max).alias("terms"))


def term_frequencies(doc_terms: DataFrame, keep: tuple[str, ...] = (), among=None) -> DataFrame:
    """V1: ``(_id, keep..., term, tf)``; ``keep`` are columns that follow from ``_id``. Rows dealt out by ``_id`` are counted
    where they are. ``among`` may leave rows ``(_id, keep..., term)`` out before they are counted."""
    # explode_outer + null filter: a plain explode makes the optimizer infer ``size(terms) > 0`` and push
    # it below the projections, which would re-evaluate the whole tokenizer inside the filter
    rows = doc_terms.select("_id", *keep, F.explode_outer("terms").alias("term")).where(F.col("term").isNotNull())
    rows = among(rows) if among else rows
    return rows.groupBy("_id", *keep, "term").agg(F.count(F.lit(1)).alias("tf"))


def frequent_hashes(doc_terms: DataFrame, min_df: int, n_parts: int) -> DataFrame:
    """``(h)``: the hashes of all terms in at least ``min_df`` documents, and of a few others that share a hash or whose document's
    id repeats. An exchange of four bytes a document's term; tf and texts of terms stay where they are."""
    rows = doc_terms.select(F.explode_outer(F.array_distinct("terms")).alias("term")).where(F.col("term").isNotNull())
    hashes = rows.select(bitfilter.key_hash("term").alias("h")).repartition(n_parts, "h")
    return hashes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_df).select("h")


def document_frequencies(tf: DataFrame) -> DataFrame:
    """V5: documents per term ``(term, df)``."""
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def fit_vocabulary(tf_train: DataFrame, n_docs: DataFrame, min_df: int = 2, max_df: float = 0.3) -> DataFrame:
    """V2+V3: ``(term, df, idf)`` with ``min_df`` absolute, ``max_df`` a share of ``n_docs``.

    ``n_docs`` is a one-row frame ``(n_docs)``; it is broadcast (one row, fixed size).
    ``idf = ln((1 + N) / (1 + df)) + 1`` (smoothed).
    """
    return _kept_terms(document_frequencies(tf_train), n_docs, min_df, max_df).select("term", "df", "idf")


def _kept_terms(rows: DataFrame, n_docs: DataFrame, min_df: int, max_df: float) -> DataFrame:
    """Rows with a ``df`` inside the bounds, and their ``idf``."""
    df = rows.crossJoin(F.broadcast(n_docs))
    kept = df.where((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * F.col("n_docs")))
    return kept.withColumn("idf", F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1)


def fitted_tfidf(tf: DataFrame, n_docs: DataFrame, min_df: int = 2, max_df: float = 0.3, sublinear_tf: bool = False,
                 n_parts: int | None = None) -> DataFrame:
    """V1-V5 in one: ``tf(_id, fitted, term, tf)`` -> ``(_id, term, tf, x, idf)``, the vocabulary fitted on the rows marked ``fitted``.

    Equal to ``tfidf(tf, fit_vocabulary(...))`` with two exchanges in all, one by term and one by document: the rows of a term
    meet once for its document frequency (a window, whose sort may spill, not a hash table), those of a document once for its norm.
    Both go to ``n_parts`` tasks (else to the session's number), so that a task's share need not grow with the input. Rows carry
    counts, not weights, through the second: these pack better."""
    if n_parts:
        tf = tf.repartition(n_parts, "term")
    seen = tf.withColumn("df", F.sum(F.when(F.col("fitted"), 1).otherwise(0)).over(Window.partitionBy("term")))
    kept = _kept_terms(seen, n_docs, min_df, max_df).select("_id", "term", "tf", "df")
    if n_parts:
        kept = kept.repartition(n_parts, "_id")
    tfc = (F.log(F.col("tf")) + 1) if sublinear_tf else F.col("tf")
    raw = _kept_terms(kept, n_docs, min_df, max_df).select("_id", "term", "tf", "idf", (tfc * F.col("idf")).alias("v"))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("_id")))
    return raw.select("_id", "term", "tf", (F.col("v") / norm).alias("x"), "idf")


def tfidf(tf: DataFrame, vocab: DataFrame, sublinear_tf: bool = False) -> DataFrame:
    """V3+V4: ``(_id, term, x)`` L2-normalised over each document's kept terms."""
    tfc = (F.log(F.col("tf")) + 1) if sublinear_tf else F.col("tf")
    raw = tf.join(vocab.select("term", "idf"), "term").select("_id", "term", (tfc * F.col("idf")).alias("v"))
    norms = raw.groupBy("_id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return raw.join(norms, "_id").select("_id", "term", (F.col("v") / F.col("norm")).alias("x"))


def corpus_shape(samples: DataFrame, x: DataFrame) -> DataFrame:
    """Documents per split, and samples x features of the matrix."""
    per_split = samples.groupBy("split").agg(F.count(F.lit(1)).alias("n_docs"))
    feats = (x.join(samples.select("_id", "split"), "_id").groupBy("split")
             .agg(F.countDistinct("_id").alias("n_rows_with_features"),
                  F.countDistinct("term").alias("n_features"),
                  F.count(F.lit(1)).alias("n_nonzero")))
    return per_split.join(feats, "split", "left")


def document_tokens(samples: DataFrame, stopwords: bool = True, id_col: str = "_id", text_col: str = "text",
                    lang_col: str | None = "lang", pattern: str = tx.WORD_PATTERN) -> DataFrame:
    """The analyzer's word sequence as rows ``(_id, pos, token)`` (0-based positions after stop-word removal)."""
    w = tx.words(text_col, pattern)
    if stopwords and lang_col is not None:
        w = tx.drop_stopwords(w, lang_col)
    staged = samples.select(F.col(id_col).alias("_id"), w.alias("_w"))
    return staged.select("_id", F.posexplode_outer("_w").alias("pos", "token")).where(F.col("token").isNotNull())
