"""Numbers of pairs in the Jaccard join: a round's grow with the classes, the last ones come once a pair."""

import random

from termlens.llm import jaccard_join


def near_copies(n, seed=5):
    r = random.Random(seed)
    base = [f"w{r.randrange(5000)}" for _ in range(300)]
    out = []
    for _ in range(n):
        words = list(base)
        for at in r.sample(range(len(words)), 3):
            words[at] = f"x{r.randrange(10 ** 9)}"
        out.append(" ".join(words))
    return out


def test_a_round_compares_a_class_with_few_others(spark, monkeypatch):
    """Near copies share many different groups; pairs must not grow with the groups a class is in."""
    counts, links_of = [], jaccard_join.links_of
    monkeypatch.setattr(jaccard_join, "links_of", lambda pairs, *rest: (counts.append(pairs.count()), links_of(pairs, *rest))[1])
    rows = list(enumerate(near_copies(60)))
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    assert {r.component_id for r in got} == {0} and len(got) == 60
    assert counts and max(counts) <= jaccard_join.NEXT * len(rows)


def test_a_pair_in_many_groups_comes_once(spark):
    """Classes 0..5 of their own components share 40 groups; groups in which the larger one does not probe give no pair."""
    cells = [3] * jaccard_join.CELLS
    rows = [(g, c, 100 + c, c, g % 2 == 0 or c < 5, cells) for g in range(40) for c in range(6)]
    rows += [(100, 6, 100, 6, False, cells), (100, 7, 100, 7, False, cells), (101, 6, 100, 6, True, cells), (101, 8, 100, 8, False, cells)]
    members = spark.createDataFrame(rows, "gid long, class long, size long, component long, probe boolean, cells array<tinyint>")
    got = sorted((r.a, r.b) for r in jaccard_join.pairs_across(members, 80).collect())
    assert got == [(a, b) for a in range(6) for b in range(a + 1, 6)] + [(6, 8)]


def test_a_pair_whose_groups_are_late_is_not_lost(spark):
    """Two classes with many groups of their own share one: it comes, whatever its place among their groups."""
    cells = [1] * jaccard_join.CELLS
    rows = [(1000 * c + g, c, 100, c, True, cells) for c in (1, 2) for g in range(5 * jaccard_join.FIRST)]
    for shared in range(5):
        members = spark.createDataFrame([*rows, *[(90000 + shared, c, 100, c, c == 2, cells) for c in (1, 2)]],
                                        "gid long, class long, size long, component long, probe boolean, cells array<tinyint>")
        assert [(r.a, r.b) for r in jaccard_join.pairs_across(members, 80).collect()] == [(1, 2)]


def test_components_of_few_links_take_few_tasks(spark):
    from termlens.llm.common import components

    held = {"spark.sql.shuffle.partitions": "97", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = components(spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (5, 5)], "a long, b long"))
        assert got.rdd.getNumPartitions() <= 2 * max(2, spark.sparkContext.defaultParallelism)
        assert {tuple(r) for r in got.collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (8, 8), (9, 8)}
        assert not components(spark.createDataFrame([], "a long, b long")).count()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
