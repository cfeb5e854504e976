"""Corpus aggregation of attributions.

Level 1 (A1) is a mergeable sum + count keyed by (term, type, pos, index, label, pred, task); level 2
(A2-A4) regroups it by ``term + over``. Output scores are rounded to ``DIGITS`` places so that ranks
do not depend on the order in which an engine adds doubles; ties are broken by ``term``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ATTR = "attr"
DIGITS = 9
NOISE_FLOOR = 1e-5
LEVEL1_KEYS = ["term", "type", "pos", "index", "label", "pred", "task"]


def _r(c, digits):
    return F.round(c, digits) if digits is not None else c


def valid_tasks(df: DataFrame) -> DataFrame:
    """task names without ``=`` or ``-``."""
    return df.where(~F.col("task").rlike("=|-"))


def type_filter(df: DataFrame, type_: str = "!sentence") -> DataFrame:
    """``!x`` keeps types other than x, ``x`` keeps type x."""
    if type_.startswith("!"):
        return df.where(F.col("type") != F.lit(type_[1:]))
    return df.where(F.col("type") == F.lit(type_))


def outcome_filter(df: DataFrame, included: str = "all") -> DataFrame:
    """correct / wrong / higher (label < pred) / all."""
    if included == "correct":
        return df.where(F.col("label") == F.col("pred"))
    if included == "wrong":
        return df.where(F.col("label") != F.col("pred"))
    if included == "higher":
        return df.where(F.col("label") < F.col("pred"))
    if included == "all":
        return df
    raise ValueError(f"unknown outcome filter {included!r}")


def risk_filter(df: DataFrame) -> DataFrame:
    """over-predictions explained for the predicted class."""
    return df.where((F.col("label") < F.col("pred")) & (F.col("index") == F.col("pred")))


def prepared(attrs: DataFrame, type_: str = "!sentence", filter_ids: DataFrame | None = None,
             attr_field: str = ATTR) -> DataFrame:
    """T1, F1, F2, F3, F4 (sign column) on raw attribution rows."""
    df = attrs.withColumn("term", F.lower("term"))
    df = valid_tasks(df)
    if filter_ids is not None:
        df = df.join(filter_ids.select("_id").distinct(), "_id", "left_semi")
    df = type_filter(df, type_)
    return df.withColumn("pos", F.col(attr_field) >= 0)


def level1(attrs: DataFrame, type_: str = "!sentence", positive_only: bool = True,
           filter_ids: DataFrame | None = None, attr_field: str = ATTR) -> DataFrame:
    """A1: ``sum(|attr|)`` and ``count`` as ``occurance`` per level-1 key."""
    df = prepared(attrs, type_, filter_ids, attr_field)
    if positive_only:
        df = df.where(F.col("pos"))
    return df.groupBy(*LEVEL1_KEYS).agg(F.sum(F.abs(F.col(attr_field))).alias(ATTR),
                                        F.count(F.lit(1)).alias("occurance"))


def sample_summary(attrs: DataFrame, attr_field: str = ATTR, digits: int | None = DIGITS) -> DataFrame:
    """Per sample and sign, over unigrams: ``sum(attr)`` and ``count`` as ``nattr``."""
    df = prepared(attrs, "!sentence", None, attr_field).where(F.col("type") == "1gram")
    return df.groupBy("_id", "pos").agg(_r(F.sum(attr_field), digits).alias(ATTR),
                                        F.count(F.lit(1)).alias("nattr"))


def avg_attr(level: DataFrame, over=("task",), digits: int | None = DIGITS) -> DataFrame:
    """A2 (after F7): ``sum(|attr|) / sum(occurance)``, ``sum(occurance)``."""
    keys = ["term", *over]
    return (level.where(F.abs(F.col(ATTR)) > NOISE_FLOOR).groupBy(*keys)
            .agg(_r(F.sum(F.abs(ATTR)) / F.sum("occurance"), digits).alias(ATTR),
                 F.sum("occurance").alias("occurance")))


def sum_sqrt_attr(level: DataFrame, over=("task",), digits: int | None = DIGITS) -> DataFrame:
    """A3: ``sqrt(sum(|attr|))``, ``sum(occurance)``."""
    keys = ["term", *over]
    return level.groupBy(*keys).agg(_r(F.sqrt(F.sum(F.abs(ATTR))), digits).alias(ATTR),
                                    F.sum("occurance").alias("occurance"))


def homogeneity_attr(level: DataFrame, over=("task",), digits: int | None = DIGITS) -> DataFrame:
    """A4: A3 score x (1 - min-max scaled entropy of the term's score distribution over groups).

    W1 share within a term; entropy per term with ``0 ln 0 = 0``; global min/max as a one-row
    aggregate broadcast to every term (J5); weight 1 when all entropies are equal (Q4).
    The per-term steps are grouped aggregations keyed by term (partial aggregation absorbs hot terms).
    """
    keys = ["term", *over]
    s = level.groupBy(*keys).agg(F.sqrt(F.sum(F.abs(ATTR))).alias("score"),
                                 F.sum("occurance").alias("occurance"))
    tot = s.groupBy("term").agg(F.sum(F.abs("score")).alias("tot"))
    share = s.join(tot, "term").select("term", F.try_divide(F.col("score"), F.col("tot")).alias("p"))
    plogp = F.when(F.col("p") > 0, F.col("p") * F.log(F.col("p"))).otherwise(F.lit(0.0))
    ent = share.groupBy("term").agg((-F.sum(plogp)).alias("h"))
    mm = ent.agg(F.min("h").alias("hmin"), F.max("h").alias("hmax"))
    weight = (ent.crossJoin(F.broadcast(mm))
              .select("term", F.when(F.col("hmax") > F.col("hmin"),
                                     1 - (F.col("h") - F.col("hmin")) / (F.col("hmax") - F.col("hmin")))
                      .otherwise(F.lit(1.0)).alias("wgt")))
    return (s.join(weight, "term")
            .select(*keys, _r(F.col("score") * F.col("wgt"), digits).alias(ATTR), "occurance"))


AGGREGATORS = {
    "avg": avg_attr,
    "sum_sqrt": sum_sqrt_attr,
    "homogeneity": homogeneity_attr,
}


def aggregate(level: DataFrame, method: str, over=("task",), digits: int | None = DIGITS) -> DataFrame:
    """A5: dispatch by name."""
    try:
        fn = AGGREGATORS[method]
    except KeyError:
        raise ValueError(f"unknown aggregator {method!r}; choose from {sorted(AGGREGATORS)}") from None
    return fn(level, over=over, digits=digits)


def avg_attr_grouping_sets(level: DataFrame, sets, digits: int | None = DIGITS) -> DataFrame:
    """A2 for several ``over`` sets in one pass (GROUPING SETS); absent keys are null."""
    cols = sorted({c for s in sets for c in s})
    lv = level.where(F.abs(F.col(ATTR)) > NOISE_FLOOR)
    return lv.groupingSets([[F.col("term"), *[F.col(c) for c in s]] for s in sets], "term", *cols).agg(
        _r(F.sum(F.abs(ATTR)) / F.sum("occurance"), digits).alias(ATTR), F.sum("occurance").alias("occurance"))
