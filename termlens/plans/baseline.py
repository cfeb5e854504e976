"""Entry 2 of the reference (TF-IDF baseline) as one lazy DataFrame chain.

samples -> n-grams -> tf -> vocabulary (train split) -> tf-idf (all splits) -> scorer (train)
-> predictions -> attributions. Each stage is a DataFrame; nothing is collected.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termlens.config import DEFAULT_TASKS, TaskMap, VectorizerConfig
from termlens.operators import attribution as xa
from termlens.operators import bitfilter, linear, vectorize
from termlens.session import kept_table
from termlens.sources import tables


# ---- fixed value: bytes of labelled text a task cuts into n-grams; its counts (some 40 times as much) stay in memory ----
TEXT_PER_TASK = 4 << 20
# ---- fixed value: bytes of labelled text whose n-grams a task of the exchanges by term and by document sorts in memory (about 11 times as much) ----
TEXT_PER_SORT = 16 << 20
# ---------------------------------------------------------------------------------------------------------------------


@dataclass
class BaselineRun:
    spark: SparkSession
    tasks: TaskMap
    samples: DataFrame  # without texts
    texts: DataFrame  # samples with their texts, joined anew where they are read
    features: DataFrame  # (_id, term, tf, x, idf, n_labels, split), by split
    labels: DataFrame
    weights: DataFrame  # (term, w array), see ``linear.wide``
    bias: DataFrame
    cfg: VectorizerConfig
    train_split: str = "train"
    materialized: bool = False
    _scores: dict = field(default_factory=dict)
    _preds: dict = field(default_factory=dict)
    _ridge: dict = field(default_factory=dict)

    def split_ids(self, split: str) -> DataFrame:
        """Ids of a split: of the split's partition."""
        return self.samples.where(F.col("split") == split).select("_id")

    def _rows(self, split: str | None) -> DataFrame:
        return self.features if split is None else self.features.where(F.col("split") == split)

    def x_of(self, split: str | None) -> DataFrame:
        """Features ``(_id, term, x)`` of a split: its partition alone is read."""
        return self._rows(split).select("_id", "term", "x")

    def known_of(self, split: str | None) -> DataFrame:
        """``(_id, term, idf, w)`` of a split: every document's known terms with their weights, once per id."""
        known = self._rows(split).select("_id", "term", "idf").join(self.weights, "term")
        return known.repartition("_id").groupBy("_id", "term").agg(F.first("idf").alias("idf"), F.first("w").alias("w"))

    @property
    def x(self) -> DataFrame:
        return self.x_of(None)

    @property
    def coef(self) -> DataFrame:
        """``(term, task, class, w)``"""
        return linear.long(self.weights, self.tasks)

    def tf_of(self, split: str | None) -> DataFrame:
        """``(_id, term, tf)`` of the vocabulary's terms, once per id; a document's rows lie together."""
        return self._rows(split).select("_id", "term", "tf").repartition("_id").groupBy("_id", "term").agg(F.max("tf").alias("tf"))

    @property
    def vocab(self) -> DataFrame:
        """``(term, df, idf)``, fitted on the train split."""
        ids = self.split_ids(self.train_split)
        tf = self._rows(self.train_split).select("_id", "term").distinct()
        return vectorize.fit_vocabulary(tf, ids.agg(F.count(F.lit(1)).alias("n_docs")), self.cfg.min_df, self.cfg.max_df)

    def _of(self, kept: dict, split: str | None, name: str, build) -> DataFrame:
        if split not in kept:
            if None in kept:
                kept[split] = kept[None].join(self.split_ids(split), "_id", "left_semi")
            else:
                kept[split] = kept_table(build(), name) if self.materialized else build()
        return kept[split]

    def scores_of(self, split: str | None) -> DataFrame:
        """``(_id, task, class, score)`` of a split (all when None), kept once per run."""
        ids = self.samples if split is None else self.samples.where(F.col("split") == split)
        return self._of(self._scores, split, "scores", lambda: linear.decision_scores(
            self.spark, self.x_of(split), ids, self.weights, self.bias, self.tasks))

    def preds_of(self, split: str | None) -> DataFrame:
        """``(_id, task, label, pred)`` of a split (all when None), kept once per run."""
        ids = self.samples if split is None else self.samples.where(F.col("split") == split)
        return self._of(self._preds, split, "predictions", lambda: linear.labelled(self.scores_of(split), ids, self.tasks))

    @property
    def scores(self) -> DataFrame:
        return self.scores_of(None)

    @property
    def preds(self) -> DataFrame:
        return self.preds_of(None)

    def attributions(self, split: str | None = "test", target: str = "pred") -> DataFrame:
        """X1 rows for one split (all splits when None), with ``split``."""
        a = xa.linear_attributions(self.x_of(split), self.preds_of(split), self.weights, target, self.tasks)
        return a.withColumn("split", F.lit(split)) if split else a.join(self.samples.select("_id", "split"), "_id")


_RUNS: dict = {}


def with_ridge(run: BaselineRun, alpha: float = 0.5, tol: float = 1e-2, max_iter: int = 100, train_split: str = "train") -> BaselineRun:
    """The same samples and features under the ridge scorer (V6), fitted once per run and parameters."""
    key = (alpha, tol, max_iter, train_split)
    if key not in run._ridge:
        ids = run.split_ids(train_split)
        coef, bias = linear.fit_ridge(run.spark, run.x_of(train_split), run.labels.join(ids, "_id", "left_semi"), run.tasks,
                                      alpha, tol, max_iter)
        weights = kept_table(linear.wide(coef, run.tasks), "ridge") if run.materialized else linear.wide(coef, run.tasks)
        run._ridge[key] = replace(run, weights=weights, bias=bias, _scores={}, _preds={}, _ridge={})
    return run._ridge[key]


def build(spark: SparkSession, sf_dir: str, tasks: TaskMap = DEFAULT_TASKS,
          cfg: VectorizerConfig | None = None, scorer: str = "centroid",
          train_split: str = "train", cache: bool = True) -> BaselineRun:
    """Build (or reuse, within the session) the fitted chain.

    With ``cache`` the reused stages are written once as Parquet tables in the shared folder (samples without texts and features by
    split, class means; scores and predictions of a split when first read): every report built on the run reads the columns and splits it
    needs instead of re-fitting, plans stay small, and the loss of an executor costs a read.
    """
    cfg = cfg or VectorizerConfig()
    key = (id(spark.sparkContext), spark.sparkContext.applicationId, sf_dir, tasks, repr(cfg), scorer, train_split)
    if cache and key in _RUNS:
        return _RUNS[key]
    run = _build(spark, sf_dir, tasks, cfg, scorer, train_split, materialize=cache)
    if cache:
        _RUNS[key] = run
    return run


def release():
    """Forget every materialized run of this process."""
    _RUNS.clear()


def _build(spark, sf_dir, tasks, cfg, scorer, train_split, materialize: bool = False) -> BaselineRun:
    keep = kept_table if materialize else (lambda d, name, by=None: d)
    s = keep(tables.samples(spark, sf_dir, tasks, sizes=True), "samples", ["split"])
    n_docs = s.where(F.col("split") == train_split).agg(F.count(F.lit(1)).alias("n_docs"))
    # n-grams are many times their text: the texts are dealt out by size, by ``_id``, and counted where they are
    n_bytes = s.agg(F.sum(F.col("n_bytes").cast("long"))).first()[0] or 0
    texts = tables.samples(spark, sf_dir, tasks, n_parts=max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // TEXT_PER_TASK)))
    marked = texts.withColumn("fitted", F.col("split") == train_split)
    terms = lambda d: vectorize.document_terms(d, cfg.ngram_range[0], cfg.ngram_range[1], pattern=cfg.token_pattern, keep=("fitted",))
    n_sorts = max(spark.sparkContext.defaultParallelism, -(-n_bytes // TEXT_PER_SORT))
    among = None
    if materialize and cfg.min_df > 1:
        # most n-grams are in one document: hashes alone tell which can be in the vocabulary, and the others are not shuffled
        seen = keep(vectorize.frequent_hashes(terms(marked.where("fitted")), cfg.min_df, n_sorts), "hashes")
        bits = bitfilter.n_bits(seen.count())
        known = bitfilter.chunks(seen, bits)
        among = lambda rows: bitfilter.passing(rows, F.col("term"), known, bits)
    x = vectorize.fitted_tfidf(vectorize.term_frequencies(terms(marked), ("fitted",), among), n_docs, cfg.min_df, cfg.max_df, cfg.sublinear_tf,
                               n_parts=n_sorts)
    labels = linear.labels_long(s, tasks)
    # a row per sample: an id that repeats has its features as often
    meta = s.groupBy("_id", "split").agg(F.count(F.lit(1)).alias("_n")).join(linear.label_counts(labels, tasks), "_id")
    x = x.join(meta, "_id").select("_id", "term", "tf", "x", "idf", "n_labels", "split", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_i")).drop("_i")
    x = keep(x, "features", ["split"])
    x_train = x.where(F.col("split") == train_split)
    train_labels = labels.join(s.where(F.col("split") == train_split).select("_id").distinct(), "_id", "left_semi")
    if scorer == "centroid":
        weights, bias = linear.centroid_weights(spark, x_train, train_labels, tasks, keep=(lambda d: keep(d, "means")) if materialize else None)
    elif scorer == "ridge":
        coef, bias = linear.fit_ridge(spark, x_train.select("_id", "term", "x"), train_labels, tasks)
        weights = keep(linear.wide(coef, tasks), "weights")
    else:
        raise ValueError(f"unknown scorer {scorer!r}")
    return BaselineRun(spark, tasks, s, texts, x, labels, weights, keep(bias, "biases"), cfg, train_split, materialized=materialize)
