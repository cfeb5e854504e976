"""Linear scorers on long-form features (V6-V8).

``fit_centroid`` is the closed-form scorer (V7): per task and class, one-vs-rest
``w = mean_class(x) - mean_rest(x)`` and ``b = -(|mean_class|^2 - |mean_rest|^2) / 2``, i.e. the
nearest-centroid decision function. Everything is a join plus grouped sums; the only broadcast
tables are the task/class grid, whose size is fixed by the configuration.
``fit_ridge`` (V6) solves one-vs-rest ridge with balanced classes by conjugate gradients over the long table.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termlens.config import TaskMap
from termlens.session import cut_lineage, placed

SCORE_DIGITS = 9
DOCS_A_BROADCAST = 1 << 20


def labels_long(samples: DataFrame, tasks: TaskMap, id_col: str = "_id") -> DataFrame:
    """Unpivot task columns: ``(_id, task, label)``."""
    return samples.unpivot([id_col], tasks.names, "task", "label").select(
        F.col(id_col).alias("_id"), "task", F.col("label").cast("int").alias("label"))


def class_stats(spark: SparkSession, labels_train: DataFrame, tasks: TaskMap) -> DataFrame:
    """``(task, class, n_class, n_total)`` for every configured class (absent classes get 0)."""
    counts = labels_train.groupBy("task", F.col("label").alias("class")).agg(F.count(F.lit(1)).alias("n_class"))
    totals = labels_train.groupBy("task").agg(F.count(F.lit(1)).alias("n_total"))
    grid = tasks.class_table(spark).select("task", "class")
    return (grid.join(counts, ["task", "class"], "left")
            .select("task", "class", F.coalesce("n_class", F.lit(0)).alias("n_class"))
            .join(totals, "task", "left")
            .select("task", "class", "n_class", F.coalesce("n_total", F.lit(0)).alias("n_total")))


def class_positions(tasks: TaskMap) -> list[tuple[int, str, int]]:
    """``(position, task, class)`` of every configured class: the order of the arrays in wide tables."""
    return [(i, t, c) for i, (t, c) in enumerate((t, c) for t, n in tasks.tasks for c in range(n))]


def wide(coef: DataFrame, tasks: TaskMap) -> DataFrame:
    """``(term, w array)``: the weights of a term in one row, classes in the order of ``class_positions``."""
    at = lambda t, c: F.max(F.when((F.col("task") == t) & (F.col("class") == c), F.col("w")))
    return coef.groupBy("term").agg(F.array(*[at(t, c) for _, t, c in class_positions(tasks)]).alias("w"))


def long(weights: DataFrame, tasks: TaskMap) -> DataFrame:
    """``(term, task, class, w)`` of a wide table."""
    parts = [F.struct(F.lit(t).alias("task"), F.lit(c).alias("class"), F.get("w", F.lit(i)).alias("w")) for i, t, c in class_positions(tasks)]
    return weights.select("term", F.explode(F.array(*parts)).alias("e")).select("term", "e.task", "e.class", "e.w").where(F.col("w").isNotNull())


def label_counts(labels: DataFrame, tasks: TaskMap) -> DataFrame:
    """``(_id, n_labels array)``: how often a document has each class (once, unless its id repeats)."""
    hit = lambda t, c: F.count(F.when((F.col("task") == t) & (F.col("label") == c), 1))
    return labels.groupBy("_id").agg(F.array(*[hit(t, c) for _, t, c in class_positions(tasks)]).alias("n_labels"))


def centroid_weights(spark: SparkSession, x_train: DataFrame, labels_train: DataFrame, tasks: TaskMap, keep=None):
    """V7 in wide form: ``(weights(term, w array), bias(task, class, b))``. A term's sums over every class are one grouped row, so
    the features are read once and shuffled once (partial sums by term); ``x_train`` may bring ``n_labels``
    (see ``label_counts``), else it is joined. ``keep`` (e.g. a table) is applied to the means, read for the weights and the bias."""
    at = class_positions(tasks)
    stats = class_stats(spark, labels_train, tasks)
    # one row: the document counts of the configured classes
    value = lambda col: F.array(*[F.max(F.when((F.col("task") == t) & (F.col("class") == c), F.col(col))) for _, t, c in at])
    stats = stats.agg(value("n_class").alias("n_class"), value("n_total").alias("n_total"))
    if "n_labels" not in x_train.columns:
        x_train = x_train.join(label_counts(labels_train, tasks), "_id", "left")
    sums = x_train.groupBy("term").agg(F.sum("x").alias("t"), *[F.sum(F.col("x") * F.get("n_labels", F.lit(i))).alias(f"s{i}") for i, _, _ in at])
    j = sums.crossJoin(F.broadcast(stats))

    def means(i):
        s = F.coalesce(F.col(f"s{i}"), F.lit(0.0))
        n, rest = F.get("n_class", F.lit(i)).cast("double"), (F.get("n_total", F.lit(i)) - F.get("n_class", F.lit(i))).cast("double")
        return (F.coalesce(F.try_divide(s, n), F.lit(0.0)), F.coalesce(F.try_divide(F.col("t") - s, rest), F.lit(0.0)))

    mu = j.select("term", *[F.array(*[means(i)[k] for i, _, _ in at]).alias(name) for k, name in enumerate(("mu_c", "mu_r"))])
    if keep is not None:
        mu = keep(mu)
    c, r = (lambda i: F.get("mu_c", F.lit(i))), (lambda i: F.get("mu_r", F.lit(i)))
    one = mu.agg(*[(F.lit(-0.5) * F.sum(c(i) * c(i) - r(i) * r(i))).alias(f"b{i}") for i, _, _ in at])
    bias = one.select(F.explode(F.array(*[F.struct(F.lit(t).alias("task"), F.lit(k).alias("class"), F.col(f"b{i}").alias("b")) for i, t, k in at])).alias("e"))
    bias = bias.select("e.*").where(F.col("b").isNotNull())  # no terms, no classes
    return mu.select("term", F.zip_with("mu_c", "mu_r", lambda u, v: u - v).alias("w")), bias


def fit_centroid(spark: SparkSession, x_train: DataFrame, labels_train: DataFrame, tasks: TaskMap,
                 keep=None):
    """V7: returns ``(coef(term, task, class, w), bias(task, class, b))``, the long form of ``centroid_weights``."""
    weights, bias = centroid_weights(spark, x_train, labels_train, tasks, keep)
    return long(weights, tasks), bias


def decision_scores(spark: SparkSession, x: DataFrame, ids: DataFrame, coef: DataFrame, bias: DataFrame,
                    tasks: TaskMap) -> DataFrame:
    """V8: ``(_id, task, class, score)`` for every document and configured class. ``coef`` is long or wide; a feature meets its
    term's weights of all classes in one row, and a document's sums are one row too."""
    at = class_positions(tasks)
    weights = wide(coef, tasks) if "class" in coef.columns else coef
    dots = x.join(weights, "term").groupBy("_id").agg(
        *[F.sum(F.col("x") * F.get("w", F.lit(i))).alias(f"d{i}") for i, _, _ in at])
    rows = F.array(*[F.struct(F.lit(t).alias("task"), F.lit(c).alias("class"), F.col(f"d{i}").alias("dot")) for i, t, c in at])
    scored = (ids.select("_id").join(dots, "_id", "left").select("_id", F.explode(rows).alias("e"))
              .select("_id", "e.*").join(F.broadcast(bias), ["task", "class"]))
    score = F.round(F.coalesce(F.col("dot"), F.lit(0.0)) + F.col("b"), SCORE_DIGITS)
    return scored.select("_id", "task", "class", score.alias("score"))


def argmax_class(scores: DataFrame) -> DataFrame:
    """Per (_id, task): the class with the highest score, ties to the lowest class."""
    best = F.max(F.struct(F.col("score"), (-F.col("class")).alias("neg_class")))
    return (scores.groupBy("_id", "task").agg(best.alias("best"))
            .select("_id", "task", (-F.col("best.neg_class")).cast("int").alias("pred")))


def predict(spark: SparkSession, x: DataFrame, samples: DataFrame, coef: DataFrame, bias: DataFrame,
            tasks: TaskMap) -> DataFrame:
    """``(_id, task, label, pred)`` for every sample and task."""
    return labelled(decision_scores(spark, x, samples, coef, bias, tasks), samples, tasks)


def labelled(scores: DataFrame, samples: DataFrame, tasks: TaskMap) -> DataFrame:
    """``(_id, task, label, pred)`` from decision scores."""
    return labels_long(samples, tasks).join(argmax_class(scores), ["_id", "task"])


def ridge_targets(tasks: TaskMap) -> list[tuple[str, int]]:
    """One-vs-rest targets: class 1 of a two-class task, else every class."""
    return [(t, c) for t, n in tasks.tasks for c in ([1] if n == 2 else range(n))]


def ridge_documents(labels_train: DataFrame, tasks: TaskMap) -> DataFrame:
    """``(_id, y0.., w0..)``: per target the value +-1 and the balanced weight ``n / (k * n_class)`` of a document
    (``k``: classes that occur); a document without a label of the task weighs nothing there."""
    counts = labels_train.where(F.col("label").isNotNull()).groupBy("task", "label").agg(F.count(F.lit(1)).alias("n_class"))
    totals = counts.groupBy("task").agg(F.sum("n_class").alias("n"), F.count(F.lit(1)).alias("k"))
    # one row per task and class, fixed by the configuration
    weights = counts.join(totals, "task").select("task", "label", (F.col("n") / (F.col("k") * F.col("n_class"))).alias("weight"))
    rows = labels_train.join(F.broadcast(weights), ["task", "label"])
    columns = []
    for i, (task, c) in enumerate(ridge_targets(tasks)):
        mine = F.col("task") == task
        columns += [F.coalesce(F.max(F.when(mine, F.when(F.col("label") == c, 1.0).otherwise(-1.0))), F.lit(0.0)).alias(f"y{i}"),
                    F.coalesce(F.max(F.when(mine, F.col("weight"))), F.lit(0.0)).alias(f"w{i}")]
    return rows.groupBy("_id").agg(*columns)


def fit_ridge(spark: SparkSession, x_train: DataFrame, labels_train: DataFrame, tasks: TaskMap,
              alpha: float = 0.5, tol: float = 1e-2, max_iter: int = 100, keep=None):
    """V6: one-vs-rest ridge with balanced class weights, targets +-1 and an unpenalised intercept, by conjugate
    gradients on tables. Returns ``(coef(term, task, class, w), bias(task, class, b))``.

    All targets are solved together, a column each. The unknowns, residuals and directions are one row per
    term; a step multiplies by ``X`` (join on term, sum per document) and by its transpose (join on document, sum per
    term), and ``keep`` (a checkpoint in the shared folder) cuts the lineage. The features are dealt out by term once, a row a term,
    and so are the vectors, which meet them where they lie: of a step only a document's partial sums are shuffled. The transpose
    gets the documents' sums by broadcasts of at most ``DOCS_A_BROADCAST`` rows. Only the sums that a step needs come to the
    driver, a few numbers per target. Features are centred by their weighted means without being made dense:
    ``X_c' W X_c p = X' W X p - m s`` with ``s = X' w`` and ``m = p's / sum(w)``. A target whose residual has
    shrunk to ``tol`` of its first stands still; the loop ends when all do, or after ``max_iter`` steps."""
    keep = keep or cut_lineage
    targets = ridge_targets(tasks)
    ks = range(len(targets))
    docs = keep(ridge_documents(labels_train, tasks))
    sums = docs.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"w{k}")).alias(f"w{k}") for k in ks], *[F.sum(F.col(f"w{k}") * F.col(f"y{k}")).alias(f"y{k}") for k in ks]).first()
    total = [sums[f"w{k}"] or 0.0 for k in ks]
    y_mean = [(sums[f"y{k}"] or 0.0) / total[k] if total[k] else 0.0 for k in ks]
    n_blocks = -(-max(1, sums["n"]) // DOCS_A_BROADCAST)
    n_parts = 3 * spark.sparkContext.defaultParallelism  # few, since a document has a partial sum in each
    # a row a term and block of documents, whose arrays are the features; a checkpoint keeps where its rows lie
    x = x_train.select("_id", "term", "x", F.pmod(F.xxhash64("_id"), F.lit(n_blocks)).alias("block")).join(docs.select("_id"), "_id", "left_semi")
    with placed(spark):
        x = cut_lineage(x.repartition(n_parts, "term").groupBy("term", "block").agg(F.collect_list(F.struct("_id", "x")).alias("e")))

    def by_term(of_docs: DataFrame, *sums_of) -> DataFrame:
        """Grouped sums by term over the features, each beside its document's row of ``of_docs``."""
        parts = []
        for i in range(n_blocks):
            some = F.broadcast(of_docs.where(F.pmod(F.xxhash64("_id"), F.lit(n_blocks)) == i))
            parts.append(x.where(F.col("block") == i).select("term", F.explode("e").alias("e")).select("term", "e.*").join(some, "_id"))
        return functools.reduce(DataFrame.unionByName, parts).groupBy("term").agg(*sums_of)

    start = by_term(docs, *[F.sum(F.col("x") * F.col(f"w{k}") * (F.col(f"y{k}") - F.lit(y_mean[k]))).alias(f"r{k}") for k in ks],
                    *[F.sum(F.col("x") * F.col(f"w{k}")).alias(f"s{k}") for k in ks])
    with placed(spark):
        state = keep(start.select("term", *[F.lit(0.0).alias(f"c{k}") for k in ks], *[f"r{k}" for k in ks],
                                  *[F.col(f"r{k}").alias(f"p{k}") for k in ks], *[f"s{k}" for k in ks]))
    first = state.agg(*[F.sum(F.col(f"r{k}") * F.col(f"r{k}")).alias(f"r{k}") for k in ks]).first()
    rr = [first[f"r{k}"] or 0.0 for k in ks]
    limit = [tol * tol * v for v in rr]
    for _ in range(max_iter):
        live = [rr[k] > limit[k] for k in ks]
        if not any(live):
            break
        met = x.join(state.select("term", *[f"p{k}" for k in ks]).hint("shuffle_hash"), "term")
        ahead = met.select(*[f"p{k}" for k in ks], F.explode("e").alias("e")).groupBy("e._id").agg(
            *[F.sum(F.col("e.x") * F.col(f"p{k}")).alias(f"q{k}") for k in ks])
        ahead = ahead.join(docs, "_id").select("_id", *[(F.col(f"w{k}") * F.col(f"q{k}")).alias(f"q{k}") for k in ks])
        back = by_term(ahead, *[F.sum(F.col("x") * F.col(f"q{k}")).alias(f"u{k}") for k in ks])
        with placed(spark):
            step = keep(state.join(back.hint("shuffle_hash"), "term"))
        got = step.agg(*[F.sum(F.col(f"p{k}") * F.col(f"u{k}")).alias(f"pu{k}") for k in ks],
                       *[F.sum(F.col(f"p{k}") * F.col(f"s{k}")).alias(f"ps{k}") for k in ks],
                       *[F.sum(F.col(f"p{k}") * F.col(f"p{k}")).alias(f"pp{k}") for k in ks]).first()
        mean = [got[f"ps{k}"] / total[k] if live[k] else 0.0 for k in ks]
        size = [rr[k] / (got[f"pu{k}"] - mean[k] * got[f"ps{k}"] + alpha * got[f"pp{k}"]) if live[k] else 0.0 for k in ks]
        rest = [F.col(f"r{k}") - F.lit(size[k]) * (F.col(f"u{k}") - F.lit(mean[k]) * F.col(f"s{k}") + F.lit(alpha) * F.col(f"p{k}")) for k in ks]
        new = step.agg(*[F.sum(rest[k] * rest[k]).alias(f"r{k}") for k in ks]).first()
        turn = [new[f"r{k}"] / rr[k] if live[k] else 0.0 for k in ks]
        state = step.select("term", *[(F.col(f"c{k}") + F.lit(size[k]) * F.col(f"p{k}")).alias(f"c{k}") for k in ks],
                            *[rest[k].alias(f"r{k}") for k in ks],
                            *[((rest[k] + F.lit(turn[k]) * F.col(f"p{k}")) if live[k] else F.col(f"p{k}")).alias(f"p{k}") for k in ks],
                            *[f"s{k}" for k in ks])
        rr = [new[f"r{k}"] if live[k] else rr[k] for k in ks]
    ends = state.agg(*[F.sum(F.col(f"s{k}") * F.col(f"c{k}")).alias(f"c{k}") for k in ks]).first()
    biases, parts = [], []
    for k, (task, c) in enumerate(targets):
        b = y_mean[k] - ((ends[f"c{k}"] or 0.0) / total[k] if total[k] else 0.0)
        signs = [(0, -1.0), (1, 1.0)] if dict(tasks.tasks)[task] == 2 else [(c, 1.0)]
        for cls, sign in signs:
            biases.append((task, cls, sign * b))
            parts.append(F.struct(F.lit(task).alias("task"), F.lit(cls).alias("class"), (F.lit(sign) * F.col(f"c{k}")).alias("w")))
    coef = state.select("term", F.explode(F.array(*parts)).alias("e")).select("term", "e.task", "e.class", "e.w")
    return coef, spark.createDataFrame(biases, "task string, class int, b double")
