"""Ridge by conjugate gradients on tables against the closed form."""

import numpy as np
import pytest

from termlens.config import TaskMap
from termlens.operators import linear

TASKS = TaskMap.of({"two": 2, "three": 3})


def data(n=30, m=7, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.random((n, m)) * (rng.random((n, m)) < 0.5)
    x[3] = 0  # a document without features
    two = (x[:, :3].sum(axis=1) + 0.2 * rng.random(n) > 0.8).astype(int)
    three = rng.integers(0, 3, n)
    return x, two, three


def closed(x, y, label, alpha):
    """Weights and intercept of weighted, centred ridge, from the normal equations."""
    counts = np.bincount(label)
    w = len(label) / (np.count_nonzero(counts) * counts[label])
    xm, ym = (w @ x) / w.sum(), (w @ y) / w.sum()
    xc = x - xm
    c = np.linalg.solve(xc.T @ (w[:, None] * xc) + alpha * np.eye(x.shape[1]), xc.T @ (w * (y - ym)))
    return c, ym - xm @ c


@pytest.fixture(scope="module")
def fitted(spark):
    x, two, three = data()
    xs = spark.createDataFrame([(int(i), f"t{j:02d}", float(x[i, j])) for i, j in zip(*np.nonzero(x))], "_id long, term string, x double").repartition(4)
    rows = [(i, t, int(v)) for t, lab in (("two", two), ("three", three)) for i, v in enumerate(lab)]
    labels = spark.createDataFrame(rows, "_id long, task string, label int")
    return x, two, three, xs, labels


def test_equals_the_closed_form(spark, fitted):
    x, two, three, xs, labels = fitted
    coef, bias = linear.fit_ridge(spark, xs, labels, TASKS, alpha=0.5, tol=1e-10)
    got = {(r.term, r.task, r["class"]): r.w for r in coef.collect()}
    b = {(r.task, r["class"]): r.b for r in bias.collect()}
    assert set(b) == {("two", 0), ("two", 1), ("three", 0), ("three", 1), ("three", 2)}
    for task, label, classes in (("two", two, [1]), ("three", three, [0, 1, 2])):
        for c in classes:
            w, b0 = closed(x, np.where(label == c, 1.0, -1.0), label, 0.5)
            assert b[task, c] == pytest.approx(b0, abs=1e-7)
            for j in range(x.shape[1]):
                assert got.get((f"t{j:02d}", task, c), 0.0) == pytest.approx(w[j], abs=1e-7)
    assert all(got[t, "two", 0] == -got[t, "two", 1] for t, task, c in got if task == "two")
    assert b["two", 0] == -b["two", 1]


def test_tolerance_stops_early_and_stays_near(spark, fitted):
    x, two, _, xs, labels = fitted
    calls = []

    def keep(df):
        from termlens.session import cut_lineage

        calls.append(1)
        return cut_lineage(df)

    coef, _ = linear.fit_ridge(spark, xs, labels, TASKS, alpha=0.5, tol=1e-2, keep=keep)
    assert len(calls) - 2 < 7  # steps
    w, _ = closed(x, np.where(two == 1, 1.0, -1.0), two, 0.5)
    got = {r.term: r.w for r in coef.where("task = 'two' and class = 1").collect()}
    near = np.array([got.get(f"t{j:02d}", 0.0) for j in range(x.shape[1])])
    assert np.linalg.norm(near - w) < 0.05 * np.linalg.norm(w)


def test_no_training_rows(spark, fitted):
    *_, xs, labels = fitted
    coef, bias = linear.fit_ridge(spark, xs.limit(0), labels.limit(0), TASKS)
    assert coef.count() == 0 and {r.b for r in bias.collect()} == {0.0}


def test_steps_leave_features_and_vectors_where_they_lie(spark, fitted):
    """A step exchanges documents' sums alone: neither features nor the rows of the terms."""
    *_, xs, labels = fitted
    plans = []

    def keep(df):
        from termlens.session import cut_lineage

        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut_lineage(df)

    linear.fit_ridge(spark, xs, labels, TASKS, alpha=0.5, tol=1e-2, max_iter=2, keep=keep)
    assert len(plans) == 4 and all("hashpartitioning(term" not in p for p in plans)
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_documents_in_several_broadcasts(spark, fitted, monkeypatch):
    x, two, _, xs, labels = fitted
    monkeypatch.setattr(linear, "DOCS_A_BROADCAST", 8)
    coef, _ = linear.fit_ridge(spark, xs, labels, TASKS, alpha=0.5, tol=1e-10)
    w, _ = closed(x, np.where(two == 1, 1.0, -1.0), two, 0.5)
    got = {r.term: r.w for r in coef.where("task = 'two' and class = 1").collect()}
    assert [got[f"t{j:02d}"] for j in range(x.shape[1])] == pytest.approx(list(w), abs=1e-7)
