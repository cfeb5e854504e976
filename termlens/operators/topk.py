"""Ranking (W3-W5, T19).

``row_number() <= k`` over ``partitionBy(over)`` is planned as a partial ``WindowGroupLimit`` before
the exchange, so each map task ships at most k rows per group: the few ``over`` groups do not
funnel all terms through one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termlens.operators.aggregate import ATTR


def top_terms(agg: DataFrame, over=("task",), k: int = 50, attr_field: str = ATTR) -> DataFrame:
    """Top k terms per ``over`` group by score desc, term asc."""
    w = Window.partitionBy(*over).orderBy(F.col(attr_field).desc(), F.col("term").asc())
    return (agg.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
            .select("term", *over, attr_field, "occurance"))


def exclusive_top_terms(agg: DataFrame, over=("task",), k: int = 50, attr_field: str = ATTR) -> DataFrame:
    """Give each term to its single best group (ties to the smallest ``over`` key), then W3.

    The window is keyed by term; after level-2 grouping a term has at most one row per group.
    """
    w = Window.partitionBy("term").orderBy(F.col(attr_field).desc(), *[F.col(o).asc() for o in over])
    one = agg.withColumn("_r1", F.row_number().over(w)).where(F.col("_r1") == 1).drop("_r1")
    return top_terms(one, over, k, attr_field)


def risk_report(agg: DataFrame, over=("task", "index", "label", "pred"), k: int = 20,
                attr_field: str = ATTR) -> DataFrame:
    """W5 + T19: top-20 per group, then ``"term (occurance)"`` joined by ``", "`` per (task, label, pred)
    in ascending score order."""
    top = top_terms(agg, over, k, attr_field)
    item = F.format_string("%s (%d)", F.col("term"), F.col("occurance"))
    ordered = F.sort_array(F.collect_list(F.struct(F.col(attr_field).alias("score"), F.col("term"),
                                                   item.alias("item"))))
    return (top.groupBy("task", "label", "pred").agg(ordered.alias("_l"))
            .select("task", "label", "pred",
                    F.array_join(F.transform("_l", lambda e: e["item"]), ", ").alias("terms")))
