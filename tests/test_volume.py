"""What is exchanged: plans and hand-worked rows of steps that must not shuffle or keep more than they need."""

import re

import pytest

from termlens.config import TaskMap
from termlens.operators import attribution as xa
from termlens.operators import linear, segments


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_word_ngrams_shuffle_texts_not_ngrams(spark):
    df = spark.createDataFrame([(1, "aa bb aa bb"), (2, "cc"), (1, "aa"), (3, "")], "id long, text string")
    out = segments.word_ngram_counts(df, "id", "text")
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan_of(out))
    assert len(keys) == 1 and re.fullmatch(r"id#\d+L, \d+", keys[0])
    assert {(r.id, r.term, r.tf, r.type) for r in out.collect()} == {
        (1, "aa", 3, "1gram"), (1, "bb", 2, "1gram"), (1, "aa bb", 2, "2gram"), (1, "bb aa", 1, "2gram"), (1, "aa bb aa", 1, "3gram"),
        (1, "bb aa bb", 1, "3gram"), (2, "cc", 1, "1gram")}


@pytest.mark.parametrize("n_steps", [20, None])
def test_softmax_path_equals_its_parts_without_rows_by_class(spark, n_steps):
    """The same as from class dots, path weights and a join; ids that repeat and a document without features included. No row per
    document, task and term is exchanged."""
    tasks = TaskMap((("a", 2), ("b", 3)))
    x = spark.createDataFrame([(1, "u", 0.6), (1, "v", 0.8), (2, "u", 1.0), (3, "w", 1.0), (3, "w", 1.0), (5, "u", 1.0)], "_id long, term string, x double")
    ids = spark.createDataFrame([(1,), (2,), (3,), (3,), (4,)], "_id long")
    coef = spark.createDataFrame([(t, k, c, 0.3 * i - 0.1 * c * j) for i, t in enumerate("uvw") for j, (k, n) in enumerate(tasks.tasks) for c in range(n)],
                                 "term string, task string, class int, w double")
    bias = spark.createDataFrame([("a", 0, 0.1), ("a", 1, -0.2), ("b", 0, 0.0), ("b", 1, 0.4), ("b", 2, 0.2)], "task string, class int, b double")
    preds = spark.createDataFrame([(i, t, 1, p) for i, p in ((1, 0), (2, 1), (3, 1), (3, 1), (4, 0), (5, 0)) for t in "ab"],
                                  "_id long, task string, label int, pred int")
    out = xa.softmax_path_attributions(spark, x, ids, linear.wide(coef, tasks), bias, preds, tasks, n_steps)
    w = xa.path_weights(xa.full_contributions(spark, x, ids, coef, tasks).distinct(), bias, preds.distinct(), n_steps or 1, single_point=n_steps is None)
    parts = xa.softmax_attributions(x.where("_id < 3"), coef, w, preds.distinct())
    rows = lambda df: sorted((r["_id"], r.task, r.term, round(r.attr, 9), r.type, r.label, r.pred, r["index"]) for r in df.collect())
    got = rows(out)
    assert [r for r in got if r[0] < 3] == rows(parts) and len([r for r in got if r[0] == 3]) == 4 and {r[0] for r in got} == {1, 2, 3}
    assert not re.search(r"hashpartitioning\(_id#\d+L?, task", plan_of(out))
