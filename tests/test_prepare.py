"""Row numbers by ranges and stratified selection by hash buckets against plain Python."""

import hashlib

import pytest
from pyspark.sql import functions as F

from termlens.operators import prepare
from termlens.operators.numbering import with_position


def test_positions_in_groups(spark):
    rows = [(i, "hot" if i % 3 else None if i % 2 else "b", (i * 37) % 101) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, g string, v long").repartition(7)
    got = {r.id: r.at for r in with_position(df, ["g"], [F.col("v").desc(), F.col("id").asc()], "at").collect()}
    for g in ("hot", "b", None):
        ids = [r[0] for r in sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0]))]
        assert [got[i] for i in ids] == list(range(len(ids)))


def test_row_index_and_empty_table(spark):
    df = spark.createDataFrame([(i * 7 % 50,) for i in range(50)], "id long").repartition(5)
    assert sorted((r.id, r.row_idx) for r in prepare.row_index(df, "id").collect()) == [(i, i) for i in range(50)]
    assert prepare.row_index(df.limit(0), "id").count() == 0


def order(ids, seed=0):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{i}:{seed}".encode()).hexdigest(), i))


@pytest.mark.parametrize("digits", [1, 4])
def test_stratified_selection(spark, monkeypatch, digits):
    monkeypatch.setattr(prepare, "BUCKET_DIGITS", digits)  # few buckets: many rows in a label's last one
    rows = [(i, 0 if i < 400 else 1 if i < 437 else None) for i in range(440)]
    df = spark.createDataFrame(rows, "id long, label int").repartition(5)
    got = {r.id: r.split for r in prepare.stratified_split(df, "id", "label", 0.1).collect()}
    want = set()
    for label in (0, 1, None):
        ids = order([i for i, x in rows if x == label])
        want |= set(ids[:int(len(ids) * 0.1 + 0.5)])
    assert {i for i, s in got.items() if s == "eval"} == want and len(got) == len(rows)
    some = df.where("label is not null")
    sample = sorted(r.id for r in prepare.stratified_sample(some, "id", "label", 100).collect())
    assert sample == sorted(order(range(400))[:92] + order(range(400, 437))[:8])
    assert prepare.stratified_sample(some, "id", "label", 10_000).count() == 437
    assert prepare.stratified_sample(some, "id", "label", 0).count() == 0
