"""Option-driven report runs (S6, S7, S9, A5): aggregates kept as Parquet, ranked lists as sorted CSV, named by options."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlens.operators import aggregate as agg
from termlens.operators import topk
from termlens.plans import baseline
from termlens.sources import sinks


def ranked_reports(run: baseline.BaselineRun, folder: str, aggregations=("homogeneity", "avg"), split: str = "test", pos: bool = True,
                   type_: str = "!sentence", included: str = "all", over=("task", "pred"), k: int = 50, force: bool = False) -> dict[str, str]:
    """Level 1 once, then per aggregation the whole ranking (Parquet) and its top and exclusive top lists (CSV), under
    names built from the options. What is there already is reused unless ``force``. Gives list name -> path."""
    spark, over = run.spark, list(over)
    base = sinks.report_name(split, "attr", pos=pos, type=type_)
    level = sinks.materialize(spark, os.path.join(folder, f"{base}_df.parquet"), lambda: agg.level1(run.attributions(split), type_, pos), force)
    if included != "all":
        level = agg.outcome_filter(level, included)
    out = {}
    for name in aggregations:
        stem = f"{sinks.report_name(base, included=included, over=over)}_{name}"
        ranked = sinks.materialize(spark, os.path.join(folder, f"{stem}_df.parquet"), lambda name=name: agg.aggregate(level, name, over), force)
        for kind, pick in (("top", topk.top_terms), ("exclusive_top", topk.exclusive_top_terms)):
            report = f"{stem}_{sinks.report_name(**{kind: k})}"
            path = os.path.join(folder, f"{report}.csv")
            lines = pick(ranked, over, k).select("term", *over, "attr", "occurance")
            out[report] = sinks.write_report_csv(lines.withColumn("_desc", -F.col("attr")).orderBy(*over, "_desc", "term").drop("_desc"), path)
    return out


def read_reports(run: baseline.BaselineRun, paths: dict[str, str], schema: str) -> DataFrame:
    """The lists of ``ranked_reports`` with a column ``report``."""
    frames = [sinks.read_report_csv(run.spark, p, schema).withColumn("report", F.lit(n)) for n, p in sorted(paths.items())]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
