"""Worked ranking example (A2, A3, A4, W3, W4) from the fixture notes."""

import pytest

from termlens.operators import aggregate as agg
from termlens.operators import topk

LEVEL1 = [("good", 0, 1.0, 2), ("good", 1, 4.0, 5), ("film", 0, 2.25, 3), ("film", 1, 2.25, 4), ("bad", 0, 9.0, 6)]


@pytest.fixture()
def level(spark):
    rows = [(t, "1gram", True, p, p, p, "sentiment", a, o) for t, p, a, o in LEVEL1]
    return spark.createDataFrame(rows, "term string, type string, pos boolean, index int, label int, pred int, "
                                       "task string, attr double, occurance long")


def _map(df):
    return {(r["term"], r["pred"]): round(r["attr"], 6) for r in df.collect()}


def test_avg(level):
    got = _map(agg.avg_attr(level, ["pred"]))
    assert got == {("good", 0): 0.5, ("good", 1): 0.8, ("film", 0): 0.75, ("film", 1): 0.5625, ("bad", 0): 1.5}


def test_sum_sqrt(level):
    got = _map(agg.sum_sqrt_attr(level, ["pred"]))
    assert got == {("good", 0): 1.0, ("good", 1): 2.0, ("film", 0): 1.5, ("film", 1): 1.5, ("bad", 0): 3.0}


def test_homogeneity(level):
    got = _map(agg.homogeneity_attr(level, ["pred"]))
    assert got == {("good", 0): 0.081704, ("good", 1): 0.163408, ("film", 0): 0.0, ("film", 1): 0.0, ("bad", 0): 3.0}


def test_homogeneity_equal_entropies_weight_one(spark):
    rows = [("a", "1gram", True, 0, 0, 0, "t", 4.0, 1), ("b", "1gram", True, 0, 0, 0, "t", 9.0, 1)]
    lv = spark.createDataFrame(rows, "term string, type string, pos boolean, index int, label int, pred int, "
                                     "task string, attr double, occurance long")
    got = {r["term"]: r["attr"] for r in agg.homogeneity_attr(lv, ["task"]).collect()}
    assert got == {"a": 2.0, "b": 3.0}


def test_exclusive_and_top1(level):
    avg = agg.avg_attr(level, ["pred"])
    excl = {(r["term"], r["pred"], r["attr"]) for r in topk.exclusive_top_terms(avg, ["pred"], 50).collect()}
    assert excl == {("bad", 0, 1.5), ("good", 1, 0.8), ("film", 0, 0.75)}
    top1 = {(r["pred"], r["term"]) for r in topk.top_terms(avg, ["pred"], 1).collect()}
    assert top1 == {(0, "bad"), (1, "good")}


def test_level1_filters(spark):
    rows = [(1, "t", "x", 0.5, "1gram", 1, 1, 1), (1, "t", "x", -0.2, "1gram", 1, 1, 1),
            (1, "t=bad", "x", 0.5, "1gram", 1, 1, 1), (1, "t", "y z", 0.3, "sentence", 1, 1, 1)]
    attrs = spark.createDataFrame(rows, "_id long, task string, term string, attr double, type string, pred int, "
                                        "label int, index int")
    pos = agg.level1(attrs).collect()
    assert [(r["term"], r["attr"], r["occurance"]) for r in pos] == [("x", 0.5, 1)]
    both = {(r["pos"], r["attr"]) for r in agg.level1(attrs, positive_only=False).collect()}
    assert both == {(True, 0.5), (False, 0.2)}
