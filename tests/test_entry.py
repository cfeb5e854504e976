"""Driver contract: entry runs at sf0.001; every registered query has a builder; a few run end to end."""

import __spark_entry__ as E


def test_entry_has_rows(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert set(df.columns) == {"term", "task", "pred", "attr", "occurance"}


def test_registry_shapes():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 50


def test_text_queries_run(spark):
    for name in ("word_ngrams", "sentences", "sectioned_sentences", "pool_avgmaxnorm", "label_profile"):
        assert E.queries()[name](spark, "/root/testdata/sf0.001").count() >= 0
