"""The fitted chain's volume: features in two exchanges, weights in one row a term, equal to the operators it is made of."""

from pyspark.sql import functions as F

from termlens.config import TaskMap
from termlens.operators import attribution as xa
from termlens.operators import linear, vectorize

TASKS = TaskMap.of({"quality": 2, "topic": 3})


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _tf(spark):
    rows = [(d, d % 3 != 0, t, 1 + (d + i) % 2) for d in range(12) for i, t in enumerate(("a", "b", f"c{d % 4}", f"only{d}", "a b")) if (d + i) % 5]
    return spark.createDataFrame(rows, "_id long, fitted boolean, term string, tf long")


def test_fitted_tfidf_equals_its_parts(spark):
    tf = _tf(spark)
    n_docs = spark.createDataFrame([(8,)], "n_docs long")
    vocab = vectorize.fit_vocabulary(tf.where("fitted"), n_docs, 2, 0.8)
    want = {(r["_id"], r["term"]): round(r["x"], 9) for r in vectorize.tfidf(tf, vocab).collect()}
    got = {(r["_id"], r["term"]): round(r["x"], 9) for r in vectorize.fitted_tfidf(tf, n_docs, 2, 0.8).collect()}
    assert got == want and got


def test_features_take_two_exchanges(spark):
    n_docs = spark.createDataFrame([(8,)], "n_docs long")
    assert _plan(vectorize.fitted_tfidf(_tf(spark), n_docs)).count("Exchange hashpartitioning") == 2


def test_features_exchanges_have_the_number_of_tasks_given(spark):
    """Both exchanges go to that many tasks, whatever the session's number, and counts go through the second, not weights."""
    n_docs = spark.createDataFrame([(8,)], "n_docs long")
    rows = lambda d: {(r["_id"], r["term"]): round(r["x"], 9) for r in d.collect()}
    dealt = vectorize.fitted_tfidf(_tf(spark), n_docs, 2, 0.8, n_parts=3)
    assert rows(dealt) == rows(vectorize.fitted_tfidf(_tf(spark), n_docs, 2, 0.8))
    exchanges = [line for line in _plan(vectorize.fitted_tfidf(_tf(spark), n_docs, 2, 0.8, n_parts=3)).splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 2 and all(", 3), REPARTITION_BY_NUM" in line for line in exchanges)


def test_counts_stay_where_their_documents_are(spark):
    docs = spark.createDataFrame([(i, "alpha beta alpha", "fr") for i in range(5)], "_id long, text string, lang string").repartition(7, "_id")
    plan = _plan(vectorize.term_frequencies(vectorize.document_terms(docs.withColumn("fitted", F.col("_id") > 2), keep=("fitted",)), ("fitted",)))
    assert plan.count("Exchange") == 1 and "hashpartitioning(_id" in plan


def test_wide_weights_are_the_long_ones(spark):
    """Ids that repeat count as often in every sum, as joins of rows would have it."""
    x = spark.createDataFrame([(1, "a", .5), (1, "a", .5), (2, "a", .25), (2, "b", 1.), (3, "b", .75)], "_id long, term string, x double")
    labels = spark.createDataFrame([(1, "quality", 0), (1, "quality", 1), (2, "quality", 1), (3, "quality", None), (1, "topic", 2), (2, "topic", 9)],
                                   "_id long, task string, label int")
    weights, bias = linear.centroid_weights(spark, x, labels, TASKS)
    sums = {(r["term"], r["task"], r["label"]): r["s"] for r in x.join(labels, "_id").groupBy("term", "task", "label").agg(F.sum("x").alias("s")).collect()}
    n = {("quality", 0): 1, ("quality", 1): 2, ("topic", 2): 1}
    total = {"quality": 4, "topic": 2}
    t = {"a": 1.25, "b": 1.75}
    coef = linear.long(weights, TASKS)
    for r in coef.collect():
        key = (r["task"], r["class"])
        s, rest = sums.get((r["term"], *key), 0.0), total[r["task"]] - n.get(key, 0)
        assert abs(r["w"] - ((s / n[key] if n.get(key) else 0.0) - (t[r["term"]] - s) / rest)) < 1e-12
    assert coef.count() == 10 and bias.count() == 5
    assert sorted(map(str, linear.wide(coef, TASKS).collect())) == sorted(map(str, weights.collect()))
    preds = spark.createDataFrame([(1, "quality", 0, 1), (1, "quality", 1, 1), (2, "topic", 9, 2), (3, "topic", 1, 0)], "_id long, task string, label int, pred int")
    for target in ("pred", "label"):
        old = xa.linear_attributions(x, preds, coef, target).select("_id", "task", "term", F.round("attr", 9), "type", "pred", "label", "index")
        new = xa.linear_attributions(x, preds, weights, target, TASKS).select("_id", "task", "term", F.round("attr", 9), "type", "pred", "label", "index")
        assert sorted(map(tuple, old.collect())) == sorted(map(tuple, new.collect()))


def test_normalising_reads_the_rows_once(spark):
    a = spark.createDataFrame([(1, "t", 3.0), (1, "t", 4.0), (None, "t", 1.0)], "_id long, task string, attr double")
    out = xa.l2_normalize(a)
    assert _plan(out).count("Exchange hashpartitioning") == 1
    assert sorted(r["attr"] for r in out.collect()) == [0.6, 0.8]


def test_bit_filter_lets_every_key_pass_and_few_others(spark):
    from termlens.operators import bitfilter

    keys = spark.range(0, 3000).select(F.concat(F.lit("k"), "id").alias("term"))
    bits = bitfilter.n_bits(3000)
    known = bitfilter.chunks(keys.select(bitfilter.key_hash("term").alias("h")), bits)
    both = keys.unionByName(spark.range(0, 20000).select(F.concat(F.lit("other"), "id").alias("term")))
    got = [r.term for r in bitfilter.passing(both, F.col("term"), known, bits).collect()]
    assert sum(t.startswith("k") for t in got) == 3000 and sum(t.startswith("other") for t in got) < 20000 / 8
    assert bitfilter.n_bits(10 ** 12) == bitfilter.MOST_BITS and bitfilter.passing(keys, F.col("term"), known.limit(0), bits).count() == 0


def test_only_possible_terms_are_shuffled_by_the_chain(spark, tmp_path, monkeypatch):
    """Terms of one train document, and unlabelled texts, are left out ahead of the exchanges; the features are the same."""
    from termlens.operators import bitfilter
    from termlens.plans import baseline

    text = lambda i: f"shared words of many texts only{i} one{i}" if i % 3 else "shared other words twice twice"
    docs = [(i, text(i), "fr", "s", 1) for i in range(90)] + [(7, text(7), "fr", "s", 1), (None, "shared words", "fr", "s", 1), (91, None, "fr", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, i % 5 and 1) for i in range(0, 92, 2)] + [(8, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    counted, plain = [], vectorize.fitted_tfidf
    monkeypatch.setattr(vectorize, "fitted_tfidf", lambda tf, *a, **k: counted.append(tf) or plain(tf, *a, **k))
    rows = lambda run: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in run.features.select("_id", "term", "tf", "x", "split").collect())
    with_filter = rows(baseline.build(spark, str(tmp_path)))
    monkeypatch.setattr(bitfilter, "passing", lambda rows, *a: rows)
    assert rows(baseline.build(spark, str(tmp_path), cache=False)) == with_filter and with_filter
    baseline.release()
    assert counted[0].count() < 0.8 * counted[1].count()
