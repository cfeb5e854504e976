"""Small column functions: token masking, reference ids, filters, ranked-term loader, target selection."""

from pyspark.sql import functions as F

from termlens.functions import arrays as ar
from termlens.functions import text as tx
from termlens.operators import attribution as xa
from termlens.operators import prepare
from termlens.sources import tables


def test_mask_positions_and_truncate(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"], [1, 3])], "t array<string>, p array<int>")
    r = df.select(tx.mask_positions("t", "p").alias("m"), tx.truncate_tokens("t", 2).alias("k")).first()
    assert r["m"] == ["a", "[MASK]", "c", "[MASK]"] and r["k"] == ["a", "b"]


def test_reference_ids(spark):
    df = spark.createDataFrame([([101, 7, 8, 102],)], "ids array<int>")
    r = df.select(ar.reference_ids("ids", 101, 102, 0).alias("r"), ar.reference_length("ids", 101, 102).alias("n")).first()
    assert r["r"] == [101, 0, 0, 102] and r["n"] == 2


def test_filters(spark):
    df = spark.createDataFrame([("t=0",), ("t=5",), ("a b",)], "s string")
    assert [r["s"] for r in df.where(tx.target_names_filter("s")).collect()] == ["t=0"]
    assert [r["s"] for r in df.where(tx.unigram_only("s")).collect()] == ["t=0", "t=5"]


def test_load_ranked(spark, tmp_path):
    p = str(tmp_path / "ranked")
    spark.createDataFrame([("x", "1,2")], "term string, _id string").write.parquet(p)
    assert tables.load_ranked(spark, p).first()["_id"] == [1, 2]


def test_select_target(spark):
    preds = spark.createDataFrame([(1, "t", 0, 1, None), (2, "t", 0, 1, "t=0")],
                                  "_id long, task string, label int, pred int, name string")
    got = {r["_id"]: r["index"] for r in xa.select_target(preds, None, name_col="name").collect()}
    assert got == {1: 1, 2: 0}


def test_stratified_sample_size(spark):
    df = spark.range(0, 50).select(F.col("id").alias("_id"), (F.col("id") % 3).cast("int").alias("y"))
    out = prepare.stratified_sample(df, "_id", "y", 10)
    assert out.count() == 10
    assert {r["y"] for r in out.collect()} == {0, 1, 2}


def test_attention_scores(spark):
    from termlens.operators import pooling

    rows = [(1, 0, layer, head, q, k, float(layer + q + k)) for layer in (0, 1) for head in (0, 1)
            for q in (0, 1) for k in (0, 1)]
    attn = spark.createDataFrame(rows, "_id long, segment int, layer int, head int, query int, key int, score double")
    got = {r["pos"]: r["attr"] for r in pooling.attention_scores(attn).collect()}
    assert got == {0: 0.5, 1: 1.5}


def test_rejects_and_process_registry(spark):
    df = spark.createDataFrame([(1, "aa bb"), (2, "")], "_id long, text string")
    kept, rejects = prepare.with_errors(df, F.col("text") != "", "empty text")
    assert [r["_id"] for r in kept.collect()] == [1]
    assert [(r["_id"], r["error"]) for r in rejects.collect()] == [(2, "empty text")]
    out = prepare.apply_process(kept, "max_len_200").first()
    assert out["tokens"] == ["aa", "bb"]


def test_clean_text_keeps_other_marks(spark):
    from termlens.functions.text import clean_text

    df = spark.createDataFrame([("it's 5:30 [x], ok (yes)!",)], "t string")
    assert df.select(clean_text("t")).first()[0] == "it's 5:30 [x] , ok ( yes ) ! "
