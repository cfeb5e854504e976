"""Registered queries: name -> (Spark builder, DuckDB oracle SQL or None).

Every builder takes ``(spark, sf_dir)`` and reads the supplied tables; every output column is
aliased identically on both sides.
"""

from __future__ import annotations

import uuid

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termlens.config import DEFAULT_TASKS
from termlens.operators import aggregate as agg
from termlens.operators import topk
from termlens.plans import baseline
from termlens.plans import sql as S

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, Callable[[], str]] = {}


def register(name: str, oracle: Callable[[], str] | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


TASKS = DEFAULT_TASKS
OVER_TP = ("task", "pred")


def _level1(spark, sf_dir, split="test", positive_only=True):
    run = baseline.build(spark, sf_dir, TASKS)
    return agg.level1(run.attributions(split), "!sentence", positive_only)


# ---- M0: flagship ---------------------------------------------------------------------------------
def _sql_top_terms_avg():
    return S.with_(S.baseline_ctes(TASKS) + [S.level1_cte(), S.avg_cte(OVER_TP)], S.top_sql(OVER_TP, 50))


@register("top_terms_avg", _sql_top_terms_avg)
def top_terms_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents + labels -> tf-idf -> centroid scorer -> attributions (test split) -> A1 -> A2 -> top 50
    per (task, pred)."""
    return topk.top_terms(agg.avg_attr(_level1(spark, sf_dir), OVER_TP), OVER_TP, 50)


# ---- M1: aggregation ------------------------------------------------------------------------------
def _base_sql(*tail):
    return S.baseline_ctes(TASKS) + list(tail)


@register("term_level1", lambda: S.with_(_base_sql(S.level1_cte()),
                                         "SELECT term, type, pos, index, label, pred, task, round(attr, 9) AS attr, "
                                         "CAST(occurance AS BIGINT) AS occurance FROM level1"))
def term_level1(spark, sf_dir):
    """A1 over the test split: sum(|attr|), count per (term, type, pos, index, label, pred, task)."""
    lv = _level1(spark, sf_dir)
    return lv.withColumn("attr", F.round("attr", agg.DIGITS))


@register("terms_avg", lambda: S.with_(_base_sql(S.level1_cte(), S.avg_cte(OVER_TP)), "SELECT * FROM agg"))
def terms_avg(spark, sf_dir):
    """A2 over (task, pred), all terms."""
    return agg.avg_attr(_level1(spark, sf_dir), OVER_TP)


@register("terms_sum_sqrt", lambda: S.with_(_base_sql(S.level1_cte(), S.sum_sqrt_cte(OVER_TP)), "SELECT * FROM agg"))
def terms_sum_sqrt(spark, sf_dir):
    """A3 over (task, pred)."""
    return agg.sum_sqrt_attr(_level1(spark, sf_dir), OVER_TP)


@register("terms_homogeneity", lambda: S.with_(_base_sql(S.level1_cte(), *S.homogeneity_ctes(OVER_TP)),
                                               "SELECT * FROM agg"))
def terms_homogeneity(spark, sf_dir):
    """A4 over (task, pred)."""
    return agg.homogeneity_attr(_level1(spark, sf_dir), OVER_TP)


@register("top_terms_homogeneity", lambda: S.with_(_base_sql(S.level1_cte(), *S.homogeneity_ctes(OVER_TP)),
                                                   S.top_sql(OVER_TP, 50)))
def top_terms_homogeneity(spark, sf_dir):
    """W3 on A4: top 50 per (task, pred)."""
    return topk.top_terms(agg.homogeneity_attr(_level1(spark, sf_dir), OVER_TP), OVER_TP, 50)


@register("top_terms_exclusive", lambda: S.with_(_base_sql(S.level1_cte(), S.avg_cte(OVER_TP)),
                                                 S.exclusive_top_sql(OVER_TP, 50)))
def top_terms_exclusive(spark, sf_dir):
    """W4 on A2: each term given to its best (task, pred), then top 50 per group."""
    return topk.exclusive_top_terms(agg.avg_attr(_level1(spark, sf_dir), OVER_TP), OVER_TP, 50)


RISK_OVER = ("task", "index", "label", "pred")


def _sql_risk():
    ctes = _base_sql(S.level1_cte(), "risk AS (SELECT * FROM level1 WHERE label < pred AND index = pred)",
                     *S.homogeneity_ctes(RISK_OVER, src="risk"),
                     f"top AS ({S.top_sql(RISK_OVER, 20)})")
    body = ("SELECT task, label, pred, string_agg(term || ' (' || CAST(occurance AS VARCHAR) || ')', ', ' "
            "ORDER BY attr ASC, term ASC) AS terms FROM top GROUP BY task, label, pred")
    return S.with_(ctes, body)


@register("risk_terms", _sql_risk)
def risk_terms(spark, sf_dir):
    """F6 -> A4 over (task, index, label, pred) -> top 20 -> "term (n)" list per (task, label, pred)."""
    lv = agg.risk_filter(_level1(spark, sf_dir))
    return topk.risk_report(agg.homogeneity_attr(lv, RISK_OVER), RISK_OVER, 20)


def _sql_sample_summary():
    body = ("SELECT _id, attr >= 0 AS pos, round(sum(attr), 9) AS attr, count(*) AS nattr FROM attrs "
            "WHERE split = 'test' AND NOT regexp_matches(task, '=|-') AND type = '1gram' GROUP BY _id, attr >= 0")
    return S.with_(_base_sql(), body)


@register("sample_attr_summary", _sql_sample_summary)
def sample_attr_summary(spark, sf_dir):
    """Per test sample and sign over unigrams: sum(attr), count as nattr."""
    run = baseline.build(spark, sf_dir, TASKS)
    return agg.sample_summary(run.attributions("test"))


def _outcome_sql(cond):
    return lambda: S.with_(_base_sql(S.level1_cte(), f"lv AS (SELECT * FROM level1 WHERE {cond})",
                                     S.avg_cte(OVER_TP, src="lv")), S.top_sql(OVER_TP, 50))


def _outcome_query(kind):
    def q(spark, sf_dir):
        return topk.top_terms(agg.avg_attr(agg.outcome_filter(_level1(spark, sf_dir), kind), OVER_TP), OVER_TP, 50)
    q.__doc__ = f"F5 ({kind}) on level 1, then A2 and top 50 per (task, pred)."
    return q


for _kind, _cond in (("correct", "label = pred"), ("wrong", "label <> pred"), ("higher", "label < pred")):
    register(f"outcome_filter_{_kind}", _outcome_sql(_cond))(_outcome_query(_kind))


@register("terms_avg_with_neg", lambda: S.with_(
    _base_sql(S.level1_cte(positive_only=False), S.avg_cte(OVER_TP)), S.top_sql(OVER_TP, 50)))
def terms_avg_with_neg(spark, sf_dir):
    """A1 keeping negative attributions (``positive_only=False``), A2, top 50 per (task, pred)."""
    lv = _level1(spark, sf_dir, positive_only=False)
    return topk.top_terms(agg.avg_attr(lv, OVER_TP), OVER_TP, 50)


GSETS = (("task",), ("task", "pred"), ("task", "label"))


def _sql_gsets():
    body = ("SELECT term, label, pred, task, round(sum(abs(attr)) / sum(occurance), 9) AS attr, "
            "CAST(sum(occurance) AS BIGINT) AS occurance FROM level1 WHERE abs(attr) > CAST(1e-5 AS DOUBLE) "
            "GROUP BY GROUPING SETS ((term, task), (term, task, pred), (term, task, label))")
    return S.with_(_base_sql(S.level1_cte()), body)


@register("terms_avg_grouping_sets", _sql_gsets)
def terms_avg_grouping_sets(spark, sf_dir):
    """A2 for the sets (task), (task, pred), (task, label) in one aggregation."""
    return agg.avg_attr_grouping_sets(_level1(spark, sf_dir), GSETS)


# ---- M4: model outputs and metrics ----------------------------------------------------------------
from termlens.operators import attribution as xa  # noqa: E402
from termlens.operators import linear, metrics  # noqa: E402

METRIC_SPLIT = "eval"


def _split_preds(run, split):
    return run.preds_of(split)


def _sql_predictions():
    cols = ", ".join(f"max(CASE WHEN p.task = '{t}' THEN p.label END) AS {t}, "
                     f"max(CASE WHEN p.task = '{t}' THEN p.pred END) AS {t}_pred" for t in TASKS.names)
    return S.with_(_base_sql(), f"SELECT p._id, s.split, {cols} FROM preds p JOIN samples s ON p._id = s._id "
                                f"GROUP BY p._id, s.split")


@register("predictions", _sql_predictions)
def predictions(spark, sf_dir):
    """One row per sample: split, each task's label and ``<task>_pred``."""
    run = baseline.build(spark, sf_dir, TASKS)
    wide = run.preds.groupBy("_id").agg(
        *[F.max(F.when(F.col("task") == t, F.col("label"))).alias(t) for t in TASKS.names],
        *[F.max(F.when(F.col("task") == t, F.col("pred"))).alias(f"{t}_pred") for t in TASKS.names])
    return wide.join(run.samples.select("_id", "split"), "_id")


RIDGE = {"alpha": 0.5, "tol": 1e-2, "max_iter": 20}


@register("ridge_predictions", lambda: S.with_(
    _base_sql(*S.ridge_ctes(TASKS, RIDGE["alpha"], RIDGE["tol"], RIDGE["max_iter"])),
    "SELECT r._id, s.split, r.task, r.label, r.pred, round(r.score, 6) AS score FROM rpreds r JOIN samples s ON s._id = r._id"))
def ridge_predictions(spark, sf_dir):
    """V6: class and score of every sample and task by ridge, balanced, fitted on the train split."""
    run = baseline.with_ridge(baseline.build(spark, sf_dir, TASKS), **RIDGE)
    best = run.scores.groupBy("_id", "task").agg(F.max("score").alias("score"))
    return (run.preds.join(best, ["_id", "task"]).join(run.samples.select("_id", "split"), "_id")
            .select("_id", "split", "task", "label", "pred", F.round("score", 6).alias("score")))


def _sql_conf_cte():
    return [f"ep AS (SELECT * FROM preds WHERE _id IN (SELECT _id FROM samples WHERE split = '{METRIC_SPLIT}'))",
            "conf AS (SELECT a.task, a.class AS label, b.class AS pred, CAST(coalesce(c.n, 0) AS BIGINT) AS n "
            "FROM classes a JOIN classes b ON a.task = b.task LEFT JOIN "
            "(SELECT task, label, pred, count(*) AS n FROM ep GROUP BY task, label, pred) c "
            "ON c.task = a.task AND c.label = a.class AND c.pred = b.class)",
            "pl AS (SELECT t.task, t.label AS class, t.task || '=' || CAST(t.label AS VARCHAR) AS name, "
            "coalesce(CAST(t.n AS DOUBLE) / NULLIF(pr.predicted, 0), 0) AS precision, "
            "coalesce(CAST(t.n AS DOUBLE) / NULLIF(su.support, 0), 0) AS recall, su.support "
            "FROM conf t JOIN (SELECT task, label, sum(n) AS support FROM conf GROUP BY task, label) su "
            "ON su.task = t.task AND su.label = t.label "
            "JOIN (SELECT task, pred, sum(n) AS predicted FROM conf GROUP BY task, pred) pr "
            "ON pr.task = t.task AND pr.pred = t.label WHERE t.label = t.pred)",
            "plf AS (SELECT *, coalesce(2 * precision * recall / NULLIF(precision + recall, 0), 0) AS f1 FROM pl)"]


@register("confusion", lambda: S.with_(_base_sql(*_sql_conf_cte()), "SELECT * FROM conf"))
def confusion(spark, sf_dir):
    """A8 on the eval split: counts over the label x pred grid per task."""
    run = baseline.build(spark, sf_dir, TASKS)
    return metrics.confusion(spark, _split_preds(run, METRIC_SPLIT), TASKS)


@register("prf_per_label", lambda: S.with_(_base_sql(*_sql_conf_cte()),
                                           "SELECT task, class, name, round(precision, 9) AS precision, "
                                           "round(recall, 9) AS recall, round(f1, 9) AS f1, "
                                           "CAST(support AS BIGINT) AS support FROM plf"))
def prf_per_label(spark, sf_dir):
    """A9 on the eval split."""
    run = baseline.build(spark, sf_dir, TASKS)
    return metrics.per_label(spark, _split_preds(run, METRIC_SPLIT), TASKS)


def _sql_averages():
    body = (
        "SELECT a.task, a.average, round(a.precision, 9) AS precision, round(a.recall, 9) AS recall, "
        "round(a.f1, 9) AS f1, round(acc.acc, 9) AS accuracy FROM ("
        "SELECT task, 'macro' AS average, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1 "
        "FROM plf GROUP BY task UNION ALL "
        "SELECT task, 'weighted', coalesce(sum(precision * support) / NULLIF(sum(support), 0), 0), "
        "coalesce(sum(recall * support) / NULLIF(sum(support), 0), 0), "
        "coalesce(sum(f1 * support) / NULLIF(sum(support), 0), 0) FROM plf GROUP BY task UNION ALL "
        "SELECT task, 'micro', acc, acc, acc FROM accs UNION ALL "
        "SELECT '*', 'macro', avg(p), avg(r), avg(f) FROM (SELECT task, avg(precision) AS p, avg(recall) AS r, "
        "avg(f1) AS f FROM plf GROUP BY task)) a LEFT JOIN accs acc ON acc.task = a.task")
    return S.with_(_base_sql(*_sql_conf_cte(),
                             "accs AS (SELECT task, coalesce(CAST(sum(CASE WHEN label = pred THEN 1 ELSE 0 END) AS DOUBLE) "
                             "/ NULLIF(count(*), 0), 0) AS acc FROM ep GROUP BY task)"), body)


@register("prf_averages", _sql_averages)
def prf_averages(spark, sf_dir):
    """Macro, micro, weighted P/R/F1 and accuracy per task; mean macro over tasks (task '*')."""
    run = baseline.build(spark, sf_dir, TASKS)
    return metrics.averages(spark, _split_preds(run, METRIC_SPLIT), TASKS)


def _sql_log_loss():
    body = ("SELECT task, round(loss, 9) AS loss FROM (SELECT task, avg(nll) AS loss FROM nll GROUP BY task "
            "UNION ALL SELECT '*', avg(loss) FROM (SELECT task, avg(nll) AS loss FROM nll GROUP BY task))")
    return S.with_(_base_sql(
        f"es AS (SELECT * FROM scores WHERE _id IN (SELECT _id FROM samples WHERE split = '{METRIC_SPLIT}'))",
        "mx AS (SELECT _id, task, max(score) AS mx FROM es GROUP BY _id, task)",
        "lse AS (SELECT es._id, es.task, mx.mx, ln(sum(exp(es.score - mx.mx))) AS lse FROM es "
        "JOIN mx ON es._id = mx._id AND es.task = mx.task GROUP BY es._id, es.task, mx.mx)",
        "nll AS (SELECT es.task, lse.lse - (es.score - lse.mx) AS nll FROM es JOIN labels_long l "
        "ON l._id = es._id AND l.task = es.task AND l.label = es.class "
        "JOIN lse ON lse._id = es._id AND lse.task = es.task)"), body)


@register("log_loss", _sql_log_loss)
def log_loss(spark, sf_dir):
    """Softmax cross-entropy of the decision scores on the eval split, per task and mean over tasks."""
    run = baseline.build(spark, sf_dir, TASKS)
    return metrics.log_loss(run.scores_of(METRIC_SPLIT), run.labels)


def _sql_effects(split):
    return [f"xs AS (SELECT * FROM x WHERE _id IN (SELECT _id FROM samples WHERE split = '{split}'))",
            f"nd AS (SELECT count(*) AS n_docs FROM samples WHERE split = '{split}')",
            "eff AS (SELECT st.term, st.occurance, c.w * st.sx / nd.n_docs AS attr, c.class AS pred, c.task "
            "FROM (SELECT term, sum(x) AS sx, count(*) AS occurance FROM xs GROUP BY term) st CROSS JOIN nd "
            "JOIN coef c ON c.term = st.term WHERE c.w * st.sx / nd.n_docs <> 0)"]


def _effects(spark, sf_dir, split):
    run = baseline.build(spark, sf_dir, TASKS)
    ids = run.split_ids(split)
    n_docs = ids.agg(F.count(F.lit(1)).alias("n_docs"))
    return xa.global_effects(run.x_of(split), n_docs, run.coef)


@register("global_effects", lambda: S.with_(_base_sql(*_sql_effects("test")),
                                            "SELECT term, occurance, round(attr, 9) AS attr, pred, task FROM eff"))
def global_effects(spark, sf_dir):
    """X2 on the test split: ``coef * mean(x)`` per (task, class, term) with document counts."""
    return _effects(spark, sf_dir, "test").withColumn("attr", F.round("attr", 9))


@register("top5_features", lambda: S.with_(
    _base_sql(*_sql_effects("train")),
    "SELECT task, pred, rank, term, round(attr, 9) AS attr FROM (SELECT *, CAST(row_number() OVER "
    "(PARTITION BY task, pred ORDER BY round(attr, 9) DESC, term ASC) AS INTEGER) AS rank FROM eff) WHERE rank <= 5"))
def top5_features(spark, sf_dir):
    """X3 on the train split: top 5 terms per (task, class) by average feature effect."""
    eff = _effects(spark, sf_dir, "train").withColumn("attr", F.round("attr", 9))
    return xa.top_features(eff, 5)


@register("distinct_top_features", lambda: S.with_(
    _base_sql(*_sql_effects("train")),
    "SELECT term, occurance, round(attr, 9) AS attr, pred, task FROM eff WHERE term IN (SELECT term FROM (SELECT term, row_number() OVER "
    "(PARTITION BY task, pred ORDER BY round(attr, 9) DESC, term ASC) AS rank FROM eff) WHERE rank <= 5)"))
def distinct_top_features(spark, sf_dir):
    """X3 on the train split: effects, in every class, of the distinct union of the classes' top 5 terms."""
    return xa.distinct_features(_effects(spark, sf_dir, "train").withColumn("attr", F.round("attr", 9)), 5)


@register("metric_rows", lambda: S.with_(_base_sql(*_sql_conf_cte()), " UNION ALL ".join(
    f"SELECT name, '{m}' AS metric, round(CAST({m} AS DOUBLE), 9) AS value FROM plf" for m in ("precision", "recall", "f1", "support"))))
def metric_rows(spark, sf_dir):
    """A14/T18 on the eval split: long rows (target name ``task=class``, metric, value)."""
    run = baseline.build(spark, sf_dir, TASKS)
    per = metrics.per_label(spark, _split_preds(run, METRIC_SPLIT), TASKS).withColumn("support", F.col("support").cast("double"))
    return per.unpivot("name", ["precision", "recall", "f1", "support"], "metric", "value").withColumn("value", F.round("value", 9))


# ---- M7: pooling and labels -----------------------------------------------------------------------
from termlens.functions import arrays as ar  # noqa: E402
from termlens.operators import pooling  # noqa: E402
from termlens.sources import tables  # noqa: E402

_SEG_CTES = [
    "seg AS (SELECT CAST(vec_id // 5 AS BIGINT) AS _id, CAST(vec_id % 5 AS INTEGER) AS segment, "
    "list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS embedding, CAST(label AS INTEGER) AS label "
    "FROM embeddings)",
    "el AS (SELECT _id, segment, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM seg)",
    "ea AS (SELECT _id, i, avg(v) AS a, max(v) AS m, sum(v) AS s FROM el GROUP BY _id, i)",
    "vec AS (SELECT _id, list(a ORDER BY i) AS avg_v, list(m ORDER BY i) AS max_v, list(s ORDER BY i) AS sum_v "
    "FROM ea GROUP BY _id)",
    "lab AS (SELECT _id, arg_min(label, segment) AS label, count(*) AS n_segments, "
    "arg_min(embedding, segment) AS first_v FROM seg GROUP BY _id)",
]


def _ln_sql(v):
    mu = f"(list_sum({v}) / len({v}))"
    var = f"(list_sum(list_transform({v}, lambda x: (x - {mu}) * (x - {mu}))) / len({v}))"
    return f"list_transform({v}, lambda x: (x - {mu}) / sqrt({var} + CAST(1e-5 AS DOUBLE)))"


_POOL_SQL = {
    "avg_pool": "avg_v",
    "avgmax_pool": "list_concat(avg_v, max_v)",
    "avgmaxnorm_pool": _ln_sql("list_concat(avg_v, max_v)"),
    "norm": _ln_sql("sum_v"),
    "norm_sum_pool": "list_transform(sum_v, lambda x: x / greatest(sqrt(abs(x)), CAST(1e-5 AS DOUBLE)))",
    "first": "first_v",
}


def _pool_sql(method):
    expr = _POOL_SQL[method]
    return lambda: S.with_(list(_SEG_CTES), f"SELECT lab._id, lab.label, lab.n_segments, "
                                            f"list_transform({expr}, lambda x: round(x, 9)) AS embedding "
                                            f"FROM lab JOIN vec ON lab._id = vec._id")


def _pool_query(method):
    def q(spark, sf_dir):
        seg = pooling.segments_from_embeddings(tables.read_table(spark, sf_dir, "embeddings"))
        return pooling.pool(seg, method)
    q.__doc__ = f"G: {method} of the segment vectors of each sample."
    return q


for _name, _method in (("pool_avg", "avg_pool"), ("pool_avgmax", "avgmax_pool"),
                       ("pool_avgmaxnorm", "avgmaxnorm_pool"), ("pool_norm", "norm"),
                       ("pool_norm_sum", "norm_sum_pool"), ("pool_first", "first")):
    register(_name, _pool_sql(_method))(_pool_query(_method))


@register("label_index", lambda: S.with_([S.samples_cte(TASKS)],
                                         "SELECT _id, [" + ", ".join(TASKS.names) + "] AS labels FROM samples"))
def label_index(spark, sf_dir):
    """L1: label vector per sample in task order."""
    return tables.samples(spark, sf_dir, TASKS).select("_id", ar.label_index(TASKS).alias("labels"))


def _sql_thermo():
    parts = ", ".join(f"list_transform(range(0, {n + 1}), lambda i: CASE WHEN i <= {t} THEN 1 ELSE 0 END)"
                      for t, n in TASKS.tasks)
    return S.with_([S.samples_cte(TASKS)], f"SELECT _id, list_concat({parts}) AS labels FROM samples")


@register("label_thermometer", _sql_thermo)
def label_thermometer(spark, sf_dir):
    """L2: thermometer (lower-triangular one-hot) labels concatenated over tasks."""
    return tables.samples(spark, sf_dir, TASKS).select("_id", ar.thermometer(TASKS).alias("labels"))


# ---- M2: text ---------------------------------------------------------------------------------------
from termlens.operators import segments  # noqa: E402


def _sql_word_ngrams():
    return (f"WITH w AS (SELECT doc_id, {S.words_sql('text')} AS w FROM documents WHERE text IS NOT NULL), "
            f"t AS (SELECT doc_id, unnest({S.ngrams_sql('w')}) AS term FROM w) "
            "SELECT doc_id, term, count(*) AS tf, CAST(len(string_split(term, ' ')) AS VARCHAR) || 'gram' AS type "
            "FROM t GROUP BY doc_id, term")


@register("word_ngrams", _sql_word_ngrams)
def word_ngrams(spark, sf_dir):
    """T2/T3/T4/V1 over all documents: (doc_id, term, type, tf)."""
    df = tables.read_table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    return segments.word_ngram_counts(df, "doc_id", "text")


def _sql_windows(size, overlap):
    return lambda: (
        f"WITH t AS (SELECT doc_id, {S.words_sql('text')} AS t FROM documents WHERE text IS NOT NULL), "
        f"w AS (SELECT doc_id, {S.windows_sql('t', size, overlap)} AS segs FROM t) "
        "SELECT doc_id, segment, CAST(len(string_split(text, ' ')) AS INTEGER) AS n_tokens, text FROM "
        "(SELECT doc_id, CAST(unnest(range(0, len(segs))) AS INTEGER) AS segment, unnest(segs) AS text FROM w)")


def _windows_query(size, overlap, doc):
    def q(spark, sf_dir):
        df = tables.read_table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
        return segments.token_windows(df, "doc_id", "text", size, overlap)
    q.__doc__ = doc
    return q


register("token_windows", _sql_windows(512, 0))(
    _windows_query(512, 0, "T5/T7/L4: documents cut into windows of 512 word tokens."))
register("overlapping_spans", _sql_windows(128, 20))(
    _windows_query(128, 20, "T6: documents cut into spans of 128 word tokens overlapping by 20."))


def _sql_sentences():
    return (f"SELECT doc_id, CAST(unnest(range(0, len(s))) AS INTEGER) AS sent_idx, unnest(s) AS sentence FROM "
            f"(SELECT doc_id, {S.sentence_split_sql('text')} AS s FROM documents WHERE text IS NOT NULL)")


@register("sentences", _sql_sentences)
def sentences(spark, sf_dir):
    """Rule-based sentences of every document (lines, then sentence ends)."""
    df = tables.read_table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    return segments.sentences(df, "doc_id", "text")


def _sql_sectioned():
    name = "trim(regexp_split_to_array(role, '(?i)(-|_|text)')[1])"
    sents = f"flatten(list_transform(string_split(text, chr(10)), lambda ln: {S.sentence_split_sql('trim(ln)')}))"
    spans = S.windows_sql("regexp_split_to_array(s, '\\s+')", segments.SPAN_SIZE, segments.SPAN_OVERLAP)
    per = (f"flatten(list_transform(ss, lambda s: CASE WHEN length(s) > {segments.SPAN_LIMIT} THEN "
           f"list_transform({spans}, lambda sp: nm || ': ' || sp) ELSE [nm || ': ' || s] END))")
    return (f"SELECT conv_id, turn, CAST(unnest(range(0, len(p))) AS INTEGER) AS sent_idx, unnest(p) AS sentence "
            f"FROM (SELECT conv_id, turn, {per} AS p FROM "
            f"(SELECT conv_id, turn, {name} AS nm, {sents} AS ss FROM conversations WHERE text IS NOT NULL))")


@register("sectioned_sentences", _sql_sectioned)
def sectioned_sentences(spark, sf_dir):
    """Conversation turns as sections (role = section name), sentences prefixed "<role>: "."""
    df = tables.read_table(spark, sf_dir, "conversations").where(F.col("text").isNotNull())
    return segments.sectioned_sentences(df, ["conv_id", "turn"], "text", "role")


_SECTIONS = ("coalesce(source, 'none')", "lang || '_code'", "'Body-text'")


def _sql_zipped_sections():
    sents = S.sentence_split_sql("trim(ln)")
    spans = S.windows_sql("regexp_split_to_array(s, '\\s+')", segments.SPAN_SIZE, segments.SPAN_OVERLAP)
    nm = f"trim(regexp_split_to_array(names[least(i, {len(_SECTIONS)})], '(?i)(-|_|text)')[1])"
    per = (f"list_transform(string_split(text, chr(10)), lambda ln, i: flatten(list_transform({sents}, lambda s: CASE WHEN length(s) > {segments.SPAN_LIMIT} "
           f"THEN list_transform({spans}, lambda sp: {nm} || ': ' || sp) ELSE [{nm} || ': ' || s] END)))")
    return (f"WITH d AS (SELECT doc_id, text, [{', '.join(_SECTIONS)}] AS names FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL), "
            f"p AS (SELECT doc_id, {per} AS p FROM d), "
            "l AS (SELECT doc_id, CAST(unnest(range(0, len(p))) AS INTEGER) AS line, unnest(p) AS q FROM p) "
            "SELECT doc_id, line, CAST(unnest(range(0, len(q))) AS INTEGER) AS sent_idx, unnest(q) AS sentence FROM l")


@register("zipped_sections", _sql_zipped_sections)
def zipped_sections(spark, sf_dir):
    """Lines of whole documents zipped with an array of section names, the last name carried on."""
    df = tables.read_table(spark, sf_dir, "documents").where("text is not null and lang is not null")
    names = F.array(*[F.expr(e) for e in _SECTIONS])
    return segments.zipped_sections(df.select("doc_id", "text", names.alias("names")), ["doc_id"], "text", "names")


def _sql_label_profile():
    return S.with_([S.samples_cte(TASKS), f"ll AS ({S.labels_long_sql(TASKS)})",
                    "pl AS (SELECT s.split, ll.task, ll.label, count(*) AS n FROM ll JOIN samples s ON s._id = ll._id "
                    "GROUP BY s.split, ll.task, ll.label)"],
                   "SELECT pl.split, pl.task, pl.label, pl.n, t.n_rows, t.n_distinct FROM pl JOIN "
                   "(SELECT split, task, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_distinct FROM pl "
                   "GROUP BY split, task) t ON t.split = pl.split AND t.task = pl.task")


@register("label_profile", _sql_label_profile)
def label_profile(spark, sf_dir):
    """Per split and task: label counts, rows, distinct labels."""
    return segments.label_profile(tables.samples(spark, sf_dir, TASKS), TASKS)


@register("clean_text", lambda: (
    f"SELECT doc_id, regexp_replace(regexp_replace(text, '{S.CLEAN_PUNCT_SQL}', ' \\1 ', 'g'), "
    "'[ \\t\\n\\x0B\\f\\r]{2,}', ' ', 'g') AS text FROM documents"))
def clean_text(spark, sf_dir):
    """Document texts with punctuation padded and runs of blanks squeezed."""
    return segments.cleaned(tables.read_table(spark, sf_dir, "documents"), "doc_id", "text")


# ---- M5: attribution methods ----------------------------------------------------------------------
from termlens.operators import vectorize  # noqa: E402

ATTR_COLS = "_id, task, term, round(attr, 9) AS attr, type, pred, label, index"
ATTR_SPLIT = "test"


def _rounded_attrs(df):
    return df.select("_id", "task", "term", F.round("attr", 9).alias("attr"), "type", "pred", "label", "index")


@register("attr_lrp", lambda: S.with_(_base_sql(), f"SELECT {ATTR_COLS} FROM attrs WHERE split = '{ATTR_SPLIT}'"))
def attr_lrp(spark, sf_dir):
    """Relevance ``x_j * W[pred, j]`` of every present term, test split."""
    run = baseline.build(spark, sf_dir, TASKS)
    return _rounded_attrs(run.attributions(ATTR_SPLIT))


def _ig_query(n_steps, doc):
    def q(spark, sf_dir):
        run = baseline.build(spark, sf_dir, TASKS)
        ids = run.split_ids(ATTR_SPLIT)
        x = run.x_of(ATTR_SPLIT)
        return _rounded_attrs(xa.softmax_path_attributions(spark, x, ids, run.weights, run.bias, run.preds_of(ATTR_SPLIT), TASKS, n_steps))
    q.__doc__ = doc
    return q


register("attr_ig", lambda: S.with_(_base_sql(*S.ig_ctes(ATTR_SPLIT, 50)), f"SELECT {ATTR_COLS} FROM ig"))(
    _ig_query(50, "X6: integrated gradients of the predicted-class probability (50 midpoints), closed form."))
register("attr_lgxa", lambda: S.with_(_base_sql(*S.ig_ctes(ATTR_SPLIT, None)), f"SELECT {ATTR_COLS} FROM ig"))(
    _ig_query(None, "X7: gradient x activation of the predicted-class probability (alpha = 1)."))


LONG_COLS = "_id, task, term, round(attr, 9) AS attr, type, pred, label, index"


def _sql_attribution_table():
    grad = ("SELECT tx._id, p.task, tx.term, abs(c.w) AS attr, CAST(len(string_split(tx.term, ' ')) AS VARCHAR) || 'gram' AS type, p.pred, p.label, "
            "p.pred AS index FROM ig_tx tx JOIN preds p ON p._id = tx._id JOIN coef c ON c.term = tx.term AND c.task = p.task AND c.class = p.pred")
    parts = {"lrp": f"SELECT * FROM attrs WHERE split = '{ATTR_SPLIT}'", "ig": "SELECT * FROM ig_ig", "lgxa": "SELECT * FROM lg_ig", "gradnorm": grad}
    rows = " UNION ALL ".join(f"SELECT '{m}' AS method, {LONG_COLS} FROM ({q})" for m, q in parts.items())
    return S.with_(_base_sql(*S.proba_ctes(), *S.ig_ctes(ATTR_SPLIT, 50, "ig_"), *S.ig_ctes(ATTR_SPLIT, None, "lg_")),
                   f"SELECT r.*, round(pb.proba, 9) AS proba FROM ({rows}) r JOIN pb ON pb._id = r._id AND pb.task = r.task")


@register("attribution_table", _sql_attribution_table)
def attribution_table(spark, sf_dir):
    """All methods in one long table with pred, label, index, task and proba, from one scan of the features."""
    from termlens.plans import evaluation

    run = baseline.build(spark, sf_dir, TASKS)
    preds = run.preds_of(ATTR_SPLIT).withColumn("index", F.col("pred")).join(evaluation.predicted_proba(run, ATTR_SPLIT), ["_id", "task"])
    out = xa.attribution_table(run.x_of(ATTR_SPLIT), run.coef, run.bias, preds, TASKS, 50)
    return out.withColumns({c: F.round(c, 9) for c in ("attr", "proba")})


@register("attr_normed", lambda: S.with_(_base_sql(
    f"ta AS (SELECT * FROM attrs WHERE split = '{ATTR_SPLIT}')",
    "nrm AS (SELECT _id, task, sqrt(sum(attr * attr)) AS n FROM ta GROUP BY _id, task)"),
    "SELECT ta._id, ta.task, ta.term, round(coalesce(ta.attr / NULLIF(nrm.n, 0), 0), 9) AS attr, ta.type, ta.pred, "
    "ta.label, ta.index FROM ta JOIN nrm ON nrm._id = ta._id AND nrm.task = ta.task"))
def attr_normed(spark, sf_dir):
    """Relevance L2-normalised over each document and task."""
    run = baseline.build(spark, sf_dir, TASKS)
    return _rounded_attrs(xa.l2_normalize(run.attributions(ATTR_SPLIT)))


@register("attr_gradnorm", lambda: S.with_(_base_sql(
    f"tx AS (SELECT * FROM x WHERE _id IN (SELECT _id FROM samples WHERE split = '{ATTR_SPLIT}'))"),
    "SELECT tx._id, p.task, tx.term, round(abs(c.w), 9) AS attr, "
    "CAST(len(string_split(tx.term, ' ')) AS VARCHAR) || 'gram' AS type, p.pred, p.label, p.pred AS index "
    "FROM tx JOIN preds p ON p._id = tx._id JOIN coef c ON c.term = tx.term AND c.task = p.task AND c.class = p.pred"))
def attr_gradnorm(spark, sf_dir):
    """Gradient magnitude ``|W[pred, j]|`` of every present term."""
    run = baseline.build(spark, sf_dir, TASKS)
    x = run.x_of(ATTR_SPLIT)
    return _rounded_attrs(xa.gradient_norm_attributions(x, run.preds_of(ATTR_SPLIT), run.coef))


@register("attr_random", lambda: S.with_(_base_sql(S.tokens_cte(ATTR_SPLIT)),
                                         f"SELECT _id, pos, token, {S.random_attr_sql(0)} AS attr FROM tokens"))
def attr_random(spark, sf_dir):
    """Repeatable random token scores (md5 of id, position, seed) for the test split."""
    s = tables.samples(spark, sf_dir, TASKS).where(F.col("split") == ATTR_SPLIT)
    return xa.random_attributions(vectorize.document_tokens(s), seed=0)


# ---- M6: evaluation -------------------------------------------------------------------------------
from termlens.operators import masking  # noqa: E402
from termlens.plans import evaluation  # noqa: E402


@register("removal_curve", lambda: S.with_(_base_sql(*S.removal_ctes(TASKS)), "SELECT * FROM curve"))
def removal_curve(spark, sf_dir):
    """Token-removal curve on the eval split for lrp, ig, lgxa and random rankings."""
    return evaluation.removal_curve(spark, sf_dir)


@register("removal_f1", lambda: S.with_(
    _base_sql(*S.removal_ctes(TASKS)),
    "SELECT method, task, removed_percentile, round(CAST(sum(CASE WHEN label = pred THEN 1 ELSE 0 END) AS DOUBLE) "
    "/ count(*), 9) AS f1, round(avg(removed_tokens), 9) AS mean_removed_tokens FROM curve "
    "GROUP BY method, task, removed_percentile"))
def removal_f1(spark, sf_dir):
    """Micro-F1 and mean removed tokens per (method, task, percentile)."""
    return masking.removal_f1(evaluation.removal_curve(spark, sf_dir))


@register("removal_label_counts", lambda: S.with_(
    _base_sql(*S.removal_ctes(TASKS)),
    "SELECT task, label, count(*) AS n_docs FROM (SELECT task, _id, arg_min(label, removed_percentile) AS label "
    "FROM curve GROUP BY task, _id) GROUP BY task, label"))
def removal_label_counts(spark, sf_dir):
    """Distinct documents per label in the removal evaluation."""
    return masking.docs_per_label(evaluation.removal_curve(spark, sf_dir))


MASK_BASE = (S.level1_cte(), S.avg_cte(OVER_TP), *S.mask_ctes("test", 50))


@register("global_masks", lambda: S.with_(_base_sql(*MASK_BASE), "SELECT * FROM steps"))
def global_masks(spark, sf_dir):
    """M1/M2: per test document and task, masking steps over its label's ranked terms (limit 50)."""
    return evaluation.global_mask_steps(spark, sf_dir)


@register("mask_eval", lambda: S.with_(_base_sql(*MASK_BASE, *S.mask_eval_ctes(TASKS)), "SELECT * FROM meval"))
def mask_eval(spark, sf_dir):
    """M3/M4: every masking step re-scored with the fitted scorer (logits, preds, labels, pred_logits)."""
    return evaluation.mask_eval(spark, sf_dir)


# ---- M3: spans ------------------------------------------------------------------------------------
@register("merge_pieces", lambda: S.with_(_base_sql(*S.span_ctes()),
                                          "SELECT _id, task, widx, word, round(attr, 9) AS attr FROM merged"))
def merge_pieces(spark, sf_dir):
    """Word pieces of the test documents merged back to words with summed attributions."""
    run = baseline.build(spark, sf_dir, TASKS)
    return evaluation.merged_words(run).withColumn("attr", F.round("attr", 9))


@register("word_ngram_attrs", lambda: S.with_(
    _base_sql(*S.span_ctes()),
    "SELECT ng.term, round(ng.attr, 9) AS attr, ng.type, ng._id, p.label, p.pred AS index, ng.task, p.pred, "
    "round(pb.proba, 9) AS proba FROM ng JOIN preds p ON p._id = ng._id AND p.task = ng.task "
    "JOIN pb ON pb._id = ng._id AND pb.task = ng.task"))
def word_ngram_attrs(spark, sf_dir):
    """T11 + F9: attributed word 1-3-grams over whole test documents (no sentence alignment)."""
    run = baseline.build(spark, sf_dir, TASKS)
    return evaluation.processed_attributions(run, with_sentences=False).withColumns({c: F.round(c, 9) for c in ("attr", "proba")})


@register("processed_attrs", lambda: S.with_(
    _base_sql(*S.span_ctes(), *S.processed_ctes()),
    "SELECT r.term, round(r.attr, 9) AS attr, r.type, r._id, p.label, p.pred AS index, r.task, p.pred, "
    "round(pb.proba, 9) AS proba FROM prows r JOIN preds p ON p._id = r._id AND p.task = r.task "
    "JOIN pb ON pb._id = r._id AND pb.task = r.task"))
def processed_attrs(spark, sf_dir):
    """T12 + T13: sentence and rest rows, n-grams inside sentences (of the whole document where sentences stay unmatched)."""
    run = baseline.build(spark, sf_dir, TASKS)
    return evaluation.processed_attributions(run).withColumns({c: F.round(c, 9) for c in ("attr", "proba")})


# ---- M8: preparation and sinks ----------------------------------------------------------------------
from termlens.operators import prepare  # noqa: E402
from termlens.session import scratch_path  # noqa: E402
from termlens.sources import sinks  # noqa: E402
from termlens.streaming import incremental  # noqa: E402


@register("class_encode", lambda: "SELECT doc_id, lang, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS lang_id "
                                  "FROM documents WHERE lang IS NOT NULL UNION ALL SELECT doc_id, lang, NULL FROM documents WHERE lang IS NULL")
def class_encode(spark, sf_dir):
    """Document language encoded as its rank among the sorted distinct languages; null stays null."""
    docs = tables.read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    return prepare.class_encode(docs, "lang")


@register("ordered_split", lambda: S.with_(
    [S.samples_cte(TASKS), "n AS (SELECT count(*) AS n FROM samples)"],
    "SELECT s._id, s.row_idx, CASE WHEN s.row_idx < n.n - ceil(n.n * CAST(0.5 AS DOUBLE)) THEN 'train' ELSE 'test' END "
    "AS split FROM (SELECT _id, row_number() OVER (ORDER BY _id) - 1 AS row_idx FROM samples) s CROSS JOIN n"))
def ordered_split(spark, sf_dir):
    """Labelled documents indexed in id order; first half train, second half test."""
    s = tables.samples(spark, sf_dir, TASKS).select("_id")
    return prepare.ordered_split(s, "_id", 0.5)


@register("stratified_split", lambda: S.with_(
    [S.samples_cte(TASKS)],
    "SELECT _id, quality, CASE WHEN rn <= round(c * CAST(0.1 AS DOUBLE)) THEN 'eval' ELSE 'train' END AS split FROM "
    "(SELECT _id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(_id AS VARCHAR) || ':0'), _id) AS rn, "
    "count(*) OVER (PARTITION BY quality) AS c FROM samples WHERE split = 'train')"))
def stratified_split(spark, sf_dir):
    """P5: 10 % of the train split per quality label moved to eval, in md5(id, seed) order."""
    s = tables.samples(spark, sf_dir, TASKS).where(F.col("split") == "train").select("_id", "quality")
    return prepare.stratified_split(s, "_id", "quality", 0.1, seed=0)


SAMPLE_N = 100


@register("stratified_sample", lambda: S.with_(
    [S.samples_cte(TASKS),
     "ts AS (SELECT _id, quality FROM samples WHERE split = 'test')",
     "cnt AS (SELECT quality, count(*) AS c FROM ts GROUP BY quality)",
     f"q AS (SELECT quality, c, c * {SAMPLE_N} / CAST((SELECT sum(c) FROM cnt) AS DOUBLE) AS ex FROM cnt)",
     "q2 AS (SELECT quality, c, CAST(floor(ex) AS BIGINT) AS base, ex - floor(ex) AS frac FROM q)",
     f"lft AS (SELECT {SAMPLE_N} - sum(base) AS lf FROM q2)",
     "alloc AS (SELECT quality, least(c, base + CASE WHEN row_number() OVER (ORDER BY frac DESC, quality ASC) <= "
     "(SELECT lf FROM lft) THEN 1 ELSE 0 END) AS k FROM q2)"],
    "SELECT t._id, t.quality FROM (SELECT ts.*, row_number() OVER (PARTITION BY ts.quality ORDER BY "
    "md5(CAST(ts._id AS VARCHAR) || ':0'), ts._id) AS rn FROM ts) t JOIN alloc a ON a.quality = t.quality "
    "WHERE t.rn <= a.k"))
def stratified_sample(spark, sf_dir):
    """A stratified sample of 100 test documents by quality label (sampling is the feature)."""
    s = tables.samples(spark, sf_dir, TASKS).where(F.col("split") == "test").select("_id", "quality")
    return prepare.stratified_sample(s, "_id", "quality", SAMPLE_N, seed=0)


@register("anti_skip", lambda: "SELECT d.doc_id, d.lang FROM documents d WHERE NOT EXISTS "
                               "(SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_skip(spark, sf_dir):
    """Documents that have no label output yet (anti join)."""
    docs = tables.read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    done = tables.read_table(spark, sf_dir, "labels").select("doc_id")
    return prepare.skip_done(docs, done, "doc_id")


@register("split_table", lambda: S.with_([S.samples_cte(TASKS)], "SELECT _id, split, lang, " + ", ".join(TASKS.names) + ", length(text) AS n_letters FROM samples "
                                         "WHERE split IN ('eval', 'test')"))
def split_table(spark, sf_dir):
    """The labelled documents written as one table by split; the eval and test splits read back."""
    path = scratch_path(spark, f"split-{uuid.uuid4().hex}")
    sinks.write_table(tables.samples(spark, sf_dir, TASKS), path, ["split"])
    back = spark.read.parquet(path).where(F.col("split").isin("eval", "test"))
    return back.select("_id", "split", "lang", *TASKS.names, F.length("text").cast("long").alias("n_letters"))


def _sql_ranked_reports():
    base = "test_attr_pos_!sentence_all_task-pred"
    lists = " UNION ALL ".join(
        f"SELECT term, task, pred, attr, occurance, '{base}_{name}_{kind}_50' AS report FROM ({fn(OVER_TP, 50, src)})"
        for name, src in (("avg", "agg"), ("homogeneity", "hagg")) for kind, fn in (("top", S.top_sql), ("exclusive_top", S.exclusive_top_sql)))
    return S.with_(_base_sql(S.level1_cte(), S.avg_cte(OVER_TP), *S.homogeneity_ctes(OVER_TP, "hagg")), lists)


@register("ranked_reports", _sql_ranked_reports)
def ranked_reports(spark, sf_dir):
    """An option-driven run: aggregates as Parquet, top and exclusive lists as sorted CSV, read back."""
    from termlens.plans import reports

    run = baseline.build(spark, sf_dir, TASKS)
    paths = reports.ranked_reports(run, scratch_path(spark, f"reports-{uuid.uuid4().hex}"), over=OVER_TP, k=50)
    return reports.read_reports(run, paths, "term string, task string, pred int, attr double, occurance long")


@register("effects_report", lambda: S.with_(_base_sql(*_sql_effects("test")), "SELECT term, occurance, round(attr, 9) AS attr, pred, task FROM eff"))
def effects_report(spark, sf_dir):
    """The whole vocabulary's global effects as a sorted CSV report of many files, read back."""
    path = scratch_path(spark, f"effects-{uuid.uuid4().hex}.csv")
    sinks.write_report_csv(global_effects(spark, sf_dir), path, ["task", "pred", "term"])
    return sinks.read_report_csv(spark, path, "term string, occurance long, attr double, pred int, task string")


@register("removal_report", lambda: S.with_(_base_sql(*S.removal_ctes(TASKS)), "SELECT * FROM curve"))
def removal_report(spark, sf_dir):
    """The removal curve as a sorted CSV report, read back."""
    curve = evaluation.removal_curve(spark, sf_dir)
    path = sinks.write_report_csv(curve, scratch_path(spark, f"removal-{uuid.uuid4().hex}.csv"), ["method", "task", "_id", "removed_percentile"])
    return sinks.read_report_csv(spark, path, curve.schema)


def _write_attrs(spark, sf_dir, name):
    run = baseline.build(spark, sf_dir, TASKS)
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")  # fresh on every call: nothing of an earlier run is read
    sinks.write_table(run.attributions(ATTR_SPLIT), path, ["split", "task"])
    return path


@register("attributions_roundtrip", lambda: S.with_(
    _base_sql(), f"SELECT {ATTR_COLS} FROM attrs WHERE split = '{ATTR_SPLIT}'"))
def attributions_roundtrip(spark, sf_dir):
    """Attributions written as one table partitioned by split and task, then read back."""
    path = _write_attrs(spark, sf_dir, "attrs")
    return _rounded_attrs(spark.read.parquet(path))


@register("incremental_level1", lambda: S.with_(
    _base_sql(S.level1_cte()),
    "SELECT term, type, pos, index, label, pred, task, round(attr, 9) AS attr, CAST(occurance AS BIGINT) AS occurance "
    "FROM level1"))
def incremental_level1(spark, sf_dir):
    """2.16: level 1 built by a file-source stream, one partial aggregate per micro-batch, then merged."""
    path = _write_attrs(spark, sf_dir, "attrs-stream")
    out = path + "-level1"
    incremental.run_incremental_level1(spark, path, out, path + "-ckpt")
    return incremental.merged_level1(spark, out).withColumn("attr", F.round("attr", 9))


@register("attr_type_normalised", lambda: S.with_(
    _base_sql(f"ta AS (SELECT _id, task, term, type, round(attr, 9) AS attr FROM attrs WHERE split = '{ATTR_SPLIT}')"),
    "SELECT _id, task, term, type, round(attr, 9) AS attr, "
    "round(CASE WHEN sd >= CAST(1e-12 AS DOUBLE) THEN (attr - mu) / sd END, 9) AS attr_normed, "
    "round(CASE WHEN mx = 0 THEN NULL ELSE attr / mx END, 9) AS attr_scaled, "
    "round(CASE WHEN sm = 0 THEN NULL ELSE attr / sm END, 9) AS attr_percentile FROM "
    "(SELECT *, avg(attr) OVER w AS mu, stddev_samp(attr) OVER w AS sd, max(abs(attr)) OVER w AS mx, "
    "sum(abs(attr)) OVER w AS sm FROM ta WINDOW w AS (PARTITION BY _id, task, type))"))
def attr_type_normalised(spark, sf_dir):
    """Relevance z-scored, max-scaled and sum-scaled per (document, task, type)."""
    run = baseline.build(spark, sf_dir, TASKS)
    a = xa.per_type_normalised(run.attributions(ATTR_SPLIT).select("_id", "task", "term", "type",
                                                                    F.round("attr", 9).alias("attr")))
    return a.select("_id", "task", "term", "type", *[F.round(c, 9).alias(c) for c in
                                                      ("attr", "attr_normed", "attr_scaled", "attr_percentile")])
