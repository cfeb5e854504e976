"""TF-IDF, array functions, pooling and metrics worked examples."""

import math

from pyspark.sql import functions as F

from termlens.config import TaskMap
from termlens.functions import arrays as ar
from termlens.operators import attribution as xa
from termlens.operators import metrics, pooling, segments, vectorize


def test_tfidf(spark):
    docs = spark.createDataFrame([(1, "aa bb", "xx"), (2, "aa cc", "xx"), (3, "bb bb", "xx")],
                                 "_id long, text string, lang string")
    tf = vectorize.term_frequencies(vectorize.document_terms(docs, 1, 1))
    n = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    vocab = vectorize.fit_vocabulary(tf, n, min_df=1, max_df=1.0)
    idf = {r["term"]: round(r["idf"], 6) for r in vocab.collect()}
    assert idf["aa"] == 1.287682 and idf["cc"] == 1.693147
    x = {(r["_id"], r["term"]): round(r["x"], 6) for r in vectorize.tfidf(tf, vocab).collect()}
    assert x[(2, "aa")] == 0.605349 and x[(2, "cc")] == 0.795961


def test_thermometer_and_slices(spark):
    tasks = TaskMap.of({"a": 2, "b": 3})
    df = spark.createDataFrame([(1, 1, [1.0, 2.0, 0.0, 0.0, math.log(2)])], "a int, b int, logits array<double>")
    r = df.select(ar.thermometer(TaskMap.of({"a": 3})).alias("t"),
                  ar.per_task_softmax("logits", tasks).alias("p"),
                  ar.per_task_argmax("logits", tasks).alias("m")).first()
    assert r["t"] == [1, 1, 0, 0]
    assert [round(v, 6) for v in r["p"][0]] == [0.268941, 0.731059]
    assert [round(v, 6) for v in r["p"][1]] == [0.25, 0.25, 0.5]
    assert r["m"] == [1, 2]


def test_pooling(spark):
    emb = spark.createDataFrame([(0, [1.0, 4.0], 0), (1, [3.0, -2.0], 0)], "vec_id long, embedding array<float>, label int")
    seg = pooling.segments_from_embeddings(emb, per_sample=5)
    avgmax = pooling.pool(seg, "avgmax_pool").first()["embedding"]
    assert avgmax == [2.0, 1.0, 3.0, 4.0]
    ln = pooling.pool(seg, "avgmaxnorm_pool").first()["embedding"]
    assert [round(v, 6) for v in ln] == [-0.447212, -1.341635, 0.447212, 1.341635]
    ns = spark.createDataFrame([([4.0, -9.0, 0.0],)], "v array<double>").select(ar.normed_sum("v").alias("o")).first()
    assert ns["o"] == [2.0, -3.0, 0.0]


def test_pooling_plan_and_null_vectors(spark):
    """The plan does not grow with the width; segments without a vector are left out; labels are the first segment's."""
    def segs(width):
        rows = [(7, 1, [float(i) for i in range(width)], 1), (7, 0, [0.0] * width, 0), (7, 2, None, 1), (8, 0, [-1.0] * width, 1), (9, 0, None, 1)]
        return spark.createDataFrame(rows, "_id long, segment int, embedding array<double>, label int")

    def size(df):
        return len(df._jdf.queryExecution().optimizedPlan().toString())
    for method in ("avg_pool", "avgmax_pool", "avgmaxnorm_pool", "norm", "norm_sum_pool", "first"):
        assert abs(size(pooling.pool(segs(300), method)) - size(pooling.pool(segs(3), method))) < 200
    got = {r["_id"]: r for r in pooling.pool(segs(3), "avgmax_pool").collect()}
    assert set(got) == {7, 8} and got[7]["label"] == 0 and got[7]["n_segments"] == 2
    assert got[7]["embedding"] == [0.0, 0.5, 1.0, 0.0, 1.0, 2.0] and got[8]["embedding"] == [-1.0] * 6
    assert {r["_id"]: r["embedding"] for r in pooling.pool(segs(3), "norm_sum_pool").collect()}[7] == [0.0, 1.0, round(2 ** 0.5, 9)]


def test_label_profile_reads_once(spark):
    tasks = TaskMap.of({"a": 2, "b": 2})
    rows = [("train", 0, 1), ("train", 1, 1), ("train", 0, None), ("test", 1, 0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "_id long, split string, a int, b int")
    out = segments.label_profile(df, tasks)
    assert {tuple(r) for r in out.collect()} == {
        ("train", "a", 0, 2, 3, 2), ("train", "a", 1, 1, 3, 2), ("train", "b", 1, 2, 3, 2), ("train", "b", None, 1, 3, 2),
        ("test", "a", 1, 1, 1, 1), ("test", "b", 0, 1, 1, 1)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_metrics(spark):
    tasks = TaskMap.of({"t": 2})
    preds = spark.createDataFrame([("t", 0, 0), ("t", 0, 1), ("t", 1, 1), ("t", 1, 1)], "task string, label int, pred int")
    pl = {r["class"]: (round(r["precision"], 6), round(r["recall"], 6), round(r["f1"], 6))
          for r in metrics.per_label(spark, preds, tasks).collect()}
    assert pl == {0: (1.0, 0.5, 0.666667), 1: (0.666667, 1.0, 0.8)}
    av = {(r["task"], r["average"]): (round(r["f1"], 6), r["accuracy"]) for r in metrics.averages(spark, preds, tasks).collect()}
    assert av[("t", "macro")][0] == 0.733333
    assert av[("t", "micro")][0] == 0.75
    assert av[("t", "weighted")][0] == 0.733333
    assert av[("t", "macro")][1] == 0.75


def test_l2_normalize(spark):
    a = spark.createDataFrame([(1, "t", "x", 3.0), (1, "t", "y", 4.0)], "_id long, task string, term string, attr double")
    got = {r["term"]: round(r["attr"], 6) for r in xa.l2_normalize(a).collect()}
    assert got == {"x": 0.6, "y": 0.8}


def test_ig_completeness(spark):
    """Integrated gradients sum to the probability change along the path (midpoint rule, 200 steps)."""
    x = spark.createDataFrame([(1, "a", 0.6), (1, "b", 0.8)], "_id long, term string, x double")
    coef = spark.createDataFrame([("a", "t", 0, 1.5), ("a", "t", 1, -0.5), ("a", "t", 2, 0.2),
                                  ("b", "t", 0, -1.0), ("b", "t", 1, 2.0), ("b", "t", 2, 0.1)],
                                 "term string, task string, class int, w double")
    bias = spark.createDataFrame([("t", 0, 0.1), ("t", 1, -0.2), ("t", 2, 0.0)], "task string, class int, b double")
    preds = spark.createDataFrame([(1, "t", 1, 1)], "_id long, task string, label int, pred int")
    tasks = TaskMap.of({"t": 3})
    ids = x.select("_id").distinct()
    dots = xa.full_contributions(spark, x, ids, coef, tasks)
    w = xa.path_weights(dots, bias, preds, 200)
    attrs = xa.softmax_attributions(x, coef, w, preds)
    total = sum(r["attr"] for r in attrs.collect())
    p = w.select("p0", "p1").first()
    assert abs(total - (p["p1"] - p["p0"])) < 1e-4
