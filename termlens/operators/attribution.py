"""Attribution scores for linear / softmax-linear scorers.

For a linear scorer the relevance of a present term is ``x_j * W[c, j]`` (X1 = X4 "lrp" on a linear
model). Integrated gradients of the class probability of a softmax-linear scorer has a closed form
(X6): with ``z_k = sum_j x_j W_kj + b_k`` and path ``alpha * x``,
``attr_j = sum_k m_k x_j W_kj``, ``m_c = mean_alpha p_c (1 - p_c)``, ``m_k = -mean_alpha p_c p_k``;
only K numbers per document are integrated (midpoint rule in an ``aggregate`` fold), then one
join with the per-class contributions. LGXA (X7) is the same evaluated at ``alpha = 1``.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termlens.functions import text as tx
from termlens.operators import linear


def explained_weights(x: DataFrame, preds: DataFrame, weights: DataFrame, tasks, target: str = "pred") -> DataFrame:
    """``(_id, term, x, task, label, pred, index, w)``: every feature with the weight of the class that ``target`` names, per task.
    A feature goes once to its term's (wide) weights and once back to its document; rows per task are made last."""
    offsets = tasks.offsets()
    at = None
    for t, n in tasks.tasks:
        mine = (F.col("task") == t) & F.col(target).between(0, n - 1)
        at = F.when(mine, F.col(target) + offsets[t]) if at is None else at.when(mine, F.col(target) + offsets[t])
    p = preds.groupBy("_id").agg(F.collect_list(F.struct("task", "label", "pred", F.col(target).alias("index"), at.alias("at"))).alias("p"))
    j = x.select("_id", "term", "x").join(weights, "term").join(p, "_id").select("_id", "term", "x", "w", F.explode("p").alias("p"))
    return j.select("_id", "term", "x", "p.task", "p.label", "p.pred", "p.index", F.get("w", F.col("p.at")).alias("w")).where(F.col("w").isNotNull())


def linear_attributions(x: DataFrame, preds: DataFrame, coef: DataFrame, target: str = "pred", tasks=None) -> DataFrame:
    """X1 ``(_id, task, term, attr, type, pred, label, index)``; non-zero effects only.

    ``target`` names the column of ``preds`` whose class is explained (X10: ``pred`` by default,
    ``label`` to explain the true class). With ``tasks``, ``coef`` is the wide table of weights.
    """
    if tasks is not None:
        j = explained_weights(x, preds, coef, tasks, target)
    else:
        p = preds.select("_id", "task", "label", "pred", F.col(target).alias("index"))
        c = coef.select("term", "task", F.col("class").alias("index"), "w")
        j = x.join(p, "_id").join(c, ["term", "task", "index"])
    out = j.select("_id", "task", "term", (F.col("x") * F.col("w")).alias("attr"), "pred", "label", "index")
    return out.where(F.col("attr") != 0).withColumn("type", tx.ngram_type("term"))


def gradient_norm_attributions(x: DataFrame, preds: DataFrame, coef: DataFrame) -> DataFrame:
    """Gradient L1 norm per present term (``|W[c, j]|``) instead of relevance."""
    p = preds.select("_id", "task", "label", "pred", F.col("pred").alias("index"))
    c = coef.select("term", "task", F.col("class").alias("index"), "w")
    j = x.join(p, "_id").join(c, ["term", "task", "index"])
    return (j.select("_id", "task", "term", F.abs(F.col("w")).alias("attr"), "pred", "label", "index")
            .withColumn("type", tx.ngram_type("term")))


def l2_normalize(attrs: DataFrame, keys=("_id", "task"), flip_sign: bool = False) -> DataFrame:
    """``attr / sqrt(sum(attr^2))`` over each document and task; optional sign flip."""
    # a window reads the rows once, where a join of grouped norms reads them twice; rows without a key are left out as by a join
    attrs = attrs.dropna(subset=list(keys))
    a = F.try_divide(F.col("attr"), F.sqrt(F.sum(F.col("attr") * F.col("attr")).over(Window.partitionBy(*keys))))
    if flip_sign:
        a = -a
    return attrs.withColumn("attr", F.coalesce(a, F.lit(0.0)))


def class_contributions(x: DataFrame, coef: DataFrame) -> DataFrame:
    """``(_id, task, class, dot)``: the linear part of each class logit (without bias)."""
    return (x.join(coef, "term").groupBy("_id", "task", "class")
            .agg(F.sum(F.col("x") * F.col("w")).alias("dot")))


def full_contributions(spark, x: DataFrame, ids: DataFrame, coef: DataFrame, tasks) -> DataFrame:
    """``(_id, task, class, dot)`` for every document of ``ids`` and every configured class (0 if none)."""
    dots = class_contributions(x, coef)
    grid = ids.select("_id").crossJoin(F.broadcast(tasks.class_table(spark).select("task", "class")))
    return grid.join(dots, ["_id", "task", "class"], "left").select(
        "_id", "task", "class", F.coalesce(F.col("dot"), F.lit(0.0)).alias("dot"))


def _probs(alpha, cls=None):
    cls = F.col("cls") if cls is None else cls
    logits = F.transform(cls, lambda e: alpha * e["dot"] + e["b"])
    mx = F.array_max(logits)
    ex = F.transform(logits, lambda z: F.exp(z - mx))
    tot = F.aggregate(ex, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(ex, lambda v: v / tot)


def _m_at(alpha, tgt_pos, cls=None):
    p = _probs(alpha, cls)
    pc = F.element_at(p, tgt_pos)
    return F.transform(p, lambda pk, k: F.when(k + 1 == tgt_pos, pc * (1 - pc)).otherwise(-pc * pk))


def _path_mean(n_steps: int, tgt_pos, cls=None):
    """The mean of ``_m_at`` over the path's ``n_steps`` midpoints."""
    alphas = F.transform(F.sequence(F.lit(0), F.lit(n_steps - 1)), lambda s: (s.cast("double") + 0.5) / n_steps)
    zero = F.transform(F.col("cls") if cls is None else cls, lambda e: F.lit(0.0))
    total = F.aggregate(alphas, zero, lambda acc, a: F.zip_with(acc, _m_at(a, tgt_pos, cls), lambda u, v: u + v))
    return F.transform(total, lambda v: v / n_steps)


def path_weights(dots: DataFrame, bias: DataFrame, preds: DataFrame, n_steps: int = 50,
                 single_point: bool = False) -> DataFrame:
    """Per (_id, task) and class k the weight ``m_k`` (see module doc), plus ``p0``/``p1`` = the
    target class probability at alpha 0 and 1. Logits along the path are ``alpha * dot_k + b_k``;
    midpoint rule over ``n_steps`` points, or alpha = 1 only (LGXA). Groups hold one entry per class."""
    grouped = (dots.join(F.broadcast(bias), ["task", "class"])
               .groupBy("_id", "task")
               .agg(F.sort_array(F.collect_list(F.struct("class", "dot", "b"))).alias("cls")))
    g = grouped.join(preds.select("_id", "task", F.col("pred").alias("target")), ["_id", "task"])
    tgt_pos = F.col("target") + 1  # classes are 0..K-1, sorted
    if single_point:
        m = _m_at(F.lit(1.0), tgt_pos)
    else:
        m = _path_mean(n_steps, tgt_pos)
    p0 = F.element_at(_probs(F.lit(0.0)), tgt_pos)
    p1 = F.element_at(_probs(F.lit(1.0)), tgt_pos)
    staged = g.select("_id", "task", "target", m.alias("_m"), p0.alias("p0"), p1.alias("p1"))
    return staged.select("_id", "task", "target", F.posexplode("_m").alias("class", "m"), "p0", "p1")


def softmax_attributions(x: DataFrame, coef: DataFrame, weights: DataFrame, preds: DataFrame) -> DataFrame:
    """X6/X7 rows: ``attr_j = sum_k m_k * x_j * W_kj`` for present terms."""
    j = (x.join(weights.select("_id", "task", "class", "m"), "_id")
         .join(coef, ["term", "task", "class"]))
    per_term = j.groupBy("_id", "task", "term").agg(F.sum(F.col("m") * F.col("x") * F.col("w")).alias("attr"))
    p = preds.select("_id", "task", "label", "pred", F.col("pred").alias("index"))
    return per_term.join(p, ["_id", "task"]).withColumn("type", tx.ngram_type("term"))


def random_attributions(tokens: DataFrame, seed: int = 0, pos_col: str = "pos") -> DataFrame:
    """Repeatable random score in [0, 1) from md5 of (_id, pos, seed) - stable under task retries."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("_id").cast("string"), F.col(pos_col).cast("string"),
                                             F.lit(str(seed)))), 1, 8), 16, 10).cast("double")
    return tokens.withColumn("attr", h / F.lit(4294967296.0))


def global_effects(x: DataFrame, n_docs: DataFrame, coef: DataFrame) -> DataFrame:
    """``coef * mean(x)`` per (task, class, term) over a split; ``occurance`` = documents with the
    term (V5); zero effects dropped (F11). ``n_docs`` is the one-row document count of the split."""
    stats = x.groupBy("term").agg(F.sum("x").alias("sx"), F.count(F.lit(1)).alias("occurance"))
    j = stats.crossJoin(F.broadcast(n_docs)).join(coef, "term")
    attr = F.col("w") * F.col("sx") / F.col("n_docs")
    return (j.select("term", "occurance", attr.alias("attr"), F.col("class").alias("pred"), "task")
            .where(F.col("attr") != 0))


def top_features(effects: DataFrame, k: int = 5) -> DataFrame:
    """Top k terms per (task, class) by average effect (ties by term)."""
    from pyspark.sql import Window

    w = Window.partitionBy("task", "pred").orderBy(F.col("attr").desc(), F.col("term").asc())
    return (effects.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("task", "pred", "rank", "term", "attr"))


def select_target(preds: DataFrame, tasks, index_col: str | None = None, name_col: str | None = None) -> DataFrame:
    """Explained class = explicit index, else the class named ``task=<class>``, else the prediction."""
    out = preds
    idx = F.col(index_col) if index_col else F.lit(None).cast("int")
    if name_col:
        named = F.when(F.col(name_col).startswith(F.concat(F.col("task"), F.lit("="))),
                       F.element_at(F.split(F.col(name_col), "="), 2).cast("int"))
    else:
        named = F.lit(None).cast("int")
    return out.withColumn("index", F.coalesce(idx, named, F.col("pred")))


def score_with(df: DataFrame, fn, schema) -> DataFrame:
    """A user scoring hook over Arrow batches (``mapInPandas``); ``fn(iterator of pandas frames)``
    yields frames of ``schema``. The model object should be shipped with the function (closure or a
    broadcast variable), loaded once per worker."""
    return df.mapInPandas(fn, schema)


def per_type_normalised(attrs: DataFrame, keys=("_id", "task", "type")) -> DataFrame:
    """Per document, task and type: z-score (sample std), division by max |attr|, by sum |attr|."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys)
    sd = F.stddev_samp("attr").over(w)
    # a spread below 1e-12 is treated as none: equal values must not turn rounding noise into z-scores
    return attrs.select(
        "*",
        F.when(sd >= 1e-12, (F.col("attr") - F.avg("attr").over(w)) / sd).alias("attr_normed"),
        F.try_divide(F.col("attr"), F.max(F.abs("attr")).over(w)).alias("attr_scaled"),
        F.try_divide(F.col("attr"), F.sum(F.abs("attr")).over(w)).alias("attr_percentile"))


def _plus(u, v):
    """A sum that leaves nulls out, as a grouped sum does."""
    return F.coalesce(u + v, u, v)


def softmax_path_attributions(spark, x: DataFrame, ids: DataFrame, coef: DataFrame, bias: DataFrame,
                              preds: DataFrame, tasks, n_steps: int | None = 50) -> DataFrame:
    """X6/X7 end to end. A feature goes once to its term's weights of all classes (``coef`` is long or wide) and once to its document,
    whose row holds its terms, their products with the classes and the path weights ``m_k`` that follow from these; rows
    per task and term are made last."""
    at = linear.class_positions(tasks)
    weights = linear.wide(coef, tasks) if "class" in coef.columns else coef
    w = lambda i: F.get("w", F.lit(i))
    # an id that repeats has its features as often: they are added up
    met = (x.select("_id", "term", "x").join(weights, "term").repartition("_id")
           .groupBy("_id", "term").agg(F.sum("x").alias("x"), F.first("w").alias("w")))
    docs = met.groupBy("_id").agg(F.collect_list(F.struct("term", "x", "w")).alias("terms"),
                                  *[F.sum(F.col("x") * w(i)).alias(f"d{i}") for i, _, _ in at])
    # one row: the biases of the configured classes
    biases = bias.agg(*[F.max(F.when((F.col("task") == t) & (F.col("class") == c), F.col("b"))).alias(f"b{i}") for i, t, c in at])
    rows = preds.groupBy("_id").agg(F.collect_list(F.struct("task", "label", "pred")).alias("p"))
    docs = docs.join(ids.groupBy("_id").agg(F.count(F.lit(1)).cast("int").alias("n_ids")), "_id").join(rows, "_id").crossJoin(F.broadcast(biases))

    def classes(t):
        """The task's class entries, each as often as the id."""
        entry = lambda i: F.struct(F.coalesce(F.col(f"d{i}"), F.lit(0.0)).alias("dot"), F.col(f"b{i}").alias("b"))
        return F.filter(F.flatten(F.array(*[F.array_repeat(entry(i), F.col("n_ids")) for i, u, _ in at if u == t])), lambda e: e["b"].isNotNull())

    def path(t):
        """``m_k`` of the task, added up over the id's predictions."""
        n = sum(u == t for _, u, _ in at)
        one = (lambda pos: _m_at(F.lit(1.0), pos, F.col(f"cls_{t}"))) if n_steps is None else (lambda pos: _path_mean(n_steps, pos, F.col(f"cls_{t}")))
        mine = F.filter("p", lambda e: e["task"] == t)
        return F.aggregate(mine, F.array_repeat(F.lit(None).cast("double"), n),
                           lambda acc, e: F.zip_with(acc, F.slice(one(e["pred"] + 1), 1, n), _plus))

    docs = docs.select("_id", "terms", "p", *[classes(t).alias(f"cls_{t}") for t in tasks.names])
    docs = docs.select("_id", "terms", "p", *[path(t).alias(f"m_{t}") for t in tasks.names])
    rows = docs.select("_id", "p", *[f"m_{t}" for t in tasks.names], F.explode("terms").alias("e")).select("*", "e.term", "e.x", "e.w")

    def attr(t):
        parts = [F.get(f"m_{t}", F.lit(k)) * (F.col("x") * w(i)) for k, i in enumerate(i for i, u, _ in at if u == t)]
        return functools.reduce(_plus, parts)

    def known(t):
        return functools.reduce(lambda u, v: u | v, [w(i).isNotNull() for i, u, _ in at if u == t])

    by_task = F.array(*[F.struct(F.lit(t).alias("task"), attr(t).alias("attr"), known(t).alias("known")) for t in tasks.names])
    out = rows.select("_id", "term", "p", F.explode(by_task).alias("a")).where("a.known").select(
        "_id", "a.task", "term", "a.attr", F.explode(F.filter("p", lambda e: e["task"] == F.col("a.task"))).alias("q"))
    return out.select("_id", "task", "term", "attr", "q.label", "q.pred", F.col("q.pred").alias("index")).withColumn("type", tx.ngram_type("term"))


def attribution_table(x: DataFrame, coef: DataFrame, bias: DataFrame, preds: DataFrame, tasks, n_steps: int = 50) -> DataFrame:
    """One long table of all methods, ``(method, _id, task, term, attr, type, pred, label, index, proba)``, for the class
    in ``index`` of ``preds(_id, task, pred, label, index, proba)``.

    The features are read and joined to the weights once. A row then holds a document's terms for a task with all class
    weights (bounded by the document), from which come its dot products, the path weights of integrated
    gradients and LGXA, and every method's terms. Zero relevance is left out (F11)."""
    k_max = max(n for _, n in tasks.tasks)
    by_class = lambda c, v: F.transform(F.sort_array(F.collect_list(F.struct(c, v))), lambda e: e[v])
    weights = coef.groupBy("term", "task").agg(by_class("class", "w").alias("w"))
    biases = bias.groupBy("task").agg(by_class("class", "b").alias("b"))  # a row per task
    docs = x.join(weights, "term").groupBy("_id", "task").agg(
        F.collect_list(F.struct("term", "x", "w")).alias("terms"),
        F.array(*[F.sum(F.col("x") * F.get("w", F.lit(c))) for c in range(k_max)]).alias("dots"))
    docs = (docs.join(F.broadcast(biases), "task").join(preds, ["_id", "task"])
            .select("*", F.transform("b", lambda b, c: F.struct(F.element_at("dots", c + 1).alias("dot"), b.alias("b"))).alias("cls"),
                    (F.col("index") + 1).alias("at")))
    docs = docs.select("*", _path_mean(n_steps, F.col("at")).alias("m_ig"), _m_at(F.lit(1.0), F.col("at")).alias("m_lgxa"))
    rows = docs.select("_id", "task", "pred", "label", "index", "proba", "at", "m_ig", "m_lgxa", F.explode("terms").alias("t"))

    def along(m):
        return F.aggregate(F.zip_with(m, F.col("t.w"), lambda u, v: u * F.col("t.x") * v), F.lit(0.0), lambda acc, v: acc + v)

    w = F.element_at("t.w", F.col("at"))
    methods = F.array(*[F.struct(F.lit(n).alias("method"), v.alias("attr")) for n, v in (
        ("lrp", F.col("t.x") * w), ("ig", along("m_ig")), ("lgxa", along("m_lgxa")), ("gradnorm", F.abs(w)))])
    out = rows.select("_id", "task", F.col("t.term").alias("term"), "pred", "label", "index", "proba", F.explode(methods).alias("m"))
    return out.where((F.col("m.method") != "lrp") | (F.col("m.attr") != 0)).select(
        "m.method", "_id", "task", "term", "m.attr", tx.ngram_type("term").alias("type"), "pred", "label", "index", "proba")


def distinct_features(effects: DataFrame, k: int = 5) -> DataFrame:
    """The distinct union of every class's top ``k`` terms, with the effect of each of them in every class."""
    return effects.join(top_features(effects, k).select("term").distinct(), "term", "left_semi")
