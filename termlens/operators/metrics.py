"""Classification metrics from (task, label, pred) rows (A8-A14, V12) - conditional sums, no UDF.

Zero denominators give 0 (as the usual metrics libraries do with ``zero_division=0``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termlens.config import TaskMap

DIGITS = 9


def _r(c):
    return F.round(c, DIGITS)


def _div(a, b):
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(spark: SparkSession, preds: DataFrame, tasks: TaskMap) -> DataFrame:
    """``(task, label, pred, n)`` over the full class x class grid (zeros included)."""
    cls = tasks.class_table(spark).select("task", "class")
    grid = (cls.withColumnRenamed("class", "label")
            .join(cls.withColumnRenamed("class", "pred"), "task"))
    counts = preds.groupBy("task", "label", "pred").agg(F.count(F.lit(1)).alias("n"))
    return (F.broadcast(grid).join(counts, ["task", "label", "pred"], "left")
            .select("task", "label", "pred", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def _per_label_raw(spark: SparkSession, preds: DataFrame, tasks: TaskMap) -> DataFrame:
    """Precision, recall, F1 and support per task and class; ``name = task=class``."""
    conf = confusion(spark, preds, tasks)
    tp = conf.where(F.col("label") == F.col("pred")).select("task", F.col("label").alias("class"),
                                                           F.col("n").alias("tp"))
    sup = conf.groupBy("task", F.col("label").alias("class")).agg(F.sum("n").alias("support"))
    prd = conf.groupBy("task", F.col("pred").alias("class")).agg(F.sum("n").alias("predicted"))
    j = tp.join(sup, ["task", "class"]).join(prd, ["task", "class"])
    p = _div(F.col("tp"), F.col("predicted"))
    r = _div(F.col("tp"), F.col("support"))
    out = j.select("task", "class", p.alias("precision"), r.alias("recall"), "support")
    f1 = _div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.select("task", "class", F.concat_ws("=", "task", F.col("class").cast("string")).alias("name"),
                      "precision", "recall", f1.alias("f1"), F.col("support").cast("bigint").alias("support"))


def per_label(spark: SparkSession, preds: DataFrame, tasks: TaskMap) -> DataFrame:
    """A9 (rounded): ``task, class, name, precision, recall, f1, support``."""
    return _per_label_raw(spark, preds, tasks).select(
        "task", "class", "name", *[_r(F.col(m)).alias(m) for m in ("precision", "recall", "f1")], "support")


def averages(spark: SparkSession, preds: DataFrame, tasks: TaskMap) -> DataFrame:
    """A10 + A11: macro / micro / weighted precision, recall, F1 and accuracy per task, plus the mean of
    the macro scores over tasks (``task = '*'``, ``average = 'macro'``)."""
    pl = _per_label_raw(spark, preds, tasks)
    macro = pl.groupBy("task").agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
                                   F.avg("f1").alias("f1")).withColumn("average", F.lit("macro"))
    w = F.col("support").cast("double")
    weighted = pl.groupBy("task").agg(*[_div(F.sum(F.col(m) * w), F.sum(w)).alias(m)
                                        for m in ("precision", "recall", "f1")]).withColumn("average", F.lit("weighted"))
    acc = preds.groupBy("task").agg(_div(F.sum(F.when(F.col("label") == F.col("pred"), 1).otherwise(0)),
                                         F.count(F.lit(1))).alias("acc"))
    # single-label multi-class: pooled tp / pooled predictions = pooled tp / pooled support = accuracy
    micro = acc.select("task", F.col("acc").alias("precision"), F.col("acc").alias("recall"),
                       F.col("acc").alias("f1"), F.lit("micro").alias("average"))
    over_tasks = macro.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
                           F.avg("f1").alias("f1")).select(F.lit("*").alias("task"), "precision", "recall", "f1",
                                                           F.lit("macro").alias("average"))
    cols = ["task", "average", "precision", "recall", "f1"]
    out = macro.select(cols).unionByName(weighted.select(cols)).unionByName(micro.select(cols)) \
        .unionByName(over_tasks.select(cols))
    out = out.join(acc, "task", "left")
    return out.select("task", "average", *[_r(F.col(m)).alias(m) for m in ("precision", "recall", "f1")],
                      _r(F.col("acc")).alias("accuracy"))


def log_loss(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """Per task ``mean(-ln softmax(score)[label])``; ``task='*'`` is the mean over tasks."""
    mx = scores.groupBy("_id", "task").agg(F.max("score").alias("mx"))
    lse = (scores.join(mx, ["_id", "task"]).groupBy("_id", "task", "mx")
           .agg(F.log(F.sum(F.exp(F.col("score") - F.col("mx")))).alias("lse")))
    own = scores.join(labels.select("_id", "task", F.col("label").alias("class")), ["_id", "task", "class"])
    nll = own.join(lse, ["_id", "task"]).select("task", (F.col("lse") - (F.col("score") - F.col("mx"))).alias("nll"))
    per_task = nll.groupBy("task").agg(F.avg("nll").alias("loss"))
    overall = per_task.agg(F.avg("loss").alias("loss")).select(F.lit("*").alias("task"), "loss")
    return per_task.unionByName(overall).select("task", _r(F.col("loss")).alias("loss"))
