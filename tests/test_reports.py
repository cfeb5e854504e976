"""Report names, sorted reports of many files, and section names zipped with lines."""

import os

from pyspark.sql import functions as F

from termlens.operators import segments
from termlens.sources import sinks


def test_names():
    assert sinks.report_name("test", "attr", pos=True, type="!sentence", included="all", over=["task", "pred"], top=50) == \
        "test_attr_pos_!sentence_all_task-pred_top_50"
    assert sinks.report_name("test", pos=False, type=None) == "test"


def test_one_order_over_all_files(spark, tmp_path):
    path = str(tmp_path / "report.csv")
    df = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("v"), (F.col("id") / 3).alias("x")).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # many files, as for a large report
    try:
        sinks.write_report_csv(df, path, ["v"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted(f for f in os.listdir(path) if f.endswith(".csv"))
    assert len(files) > 1
    seen = [int(line.split(",")[0]) for f in files for line in open(f"{path}/{f}").read().splitlines()[1:]]
    assert seen == list(range(5000))
    back = sinks.read_report_csv(spark, path, "v long, x double")
    assert back.join(df, ["v", "x"]).count() == 5000


def test_lines_zip_with_section_names(spark):
    rows = [(1, "One a. Two b.\nThree.\n\nFour.", ["Head-x", "body_text"]), (2, "A.\nB.", ["n", "m", "unused"]), (3, "A.", [])]
    df = spark.createDataFrame(rows, "id long, text string, names array<string>")
    got = [tuple(r) for r in segments.zipped_sections(df, ["id"], "text", "names").orderBy("id", "line", "sent_idx").collect()]
    assert got == [(1, 0, 0, "Head: One a."), (1, 0, 1, "Head: Two b."), (1, 1, 0, "body: Three."), (1, 3, 0, "body: Four."),
                   (2, 0, 0, "n: A."), (2, 1, 0, "m: B.")]
    cut = segments.zipped_sections(df, ["id"], "text", "names", carry=False).where("id = 1")
    assert {r.line for r in cut.collect()} == {0, 1}
