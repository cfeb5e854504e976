"""Conversation trie against the definition, over many range shards, and the cases the docstring defines."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from termlens.llm import conversation_trie as ct
from termlens.llm import queries

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(convs: dict[int, list[tuple[str, str]]]) -> list[tuple]:
    """A row per node, straight from the definition."""
    members: dict[tuple, list[int]] = {}
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    kids: dict[tuple, list[tuple]] = {k: [] for k in members}
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        own = (len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0
        leaves[k] = sum(leaves[x] for x in kids[k]) if kids[k] else 1
        saved[k] = own + sum(saved[x] for x in kids[k])
    return sorted(((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k],
                    hashlib.sha256(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(k)).encode()).hexdigest())
                   for k, m in members.items()), key=str)


def trie(spark, convs, shard):
    rows = [(c, d, hashlib.md5(f"{len(r.encode())}:{r}{x}".encode()).hexdigest(), len(x.encode())) for c, seq in convs.items()
            for d, (r, x) in enumerate(seq, 1)]
    turns = spark.createDataFrame(rows, "conv long, depth long, h string, n long").repartition(3)
    ids = spark.createDataFrame([(c,) for c in convs], "conv long")
    return sorted((tuple(r[n] for n in NAMES) for r in ct.prefix_trie(ids, turns, shard).collect()), key=str)


def shapes():
    rng = random.Random(3)
    word = lambda: (rng.choice("ua"), rng.choice(["", "x", "yé", "zzz"]))
    yield "bushy", {i: [word() for _ in range(rng.randint(0, 5))] for i in range(120)}
    trunk = [word() for _ in range(150)]  # over several blocks of turns
    yield "long", {i * 7 - 30: trunk[:rng.choice([0, 1, 9, 63, 64, 65, 100, 127, 128, 129, 150])] + [word() for _ in range(rng.choice([0, 0, 1, 3, 70]))]
                   for i in range(60)}
    same = [word() for _ in range(12)]
    yield "copies", {i: same if i % 3 else [word() for _ in range(3)] for i in range(90)}
    yield "turnless", {i: [] for i in range(5)}
    yield "one", {-4: [("u", "x")] * 3}


@pytest.mark.parametrize("shard", [20, 1 << 17])
@pytest.mark.parametrize("name,convs", list(shapes()))
def test_nodes_equal_the_definition(spark, name, convs, shard):
    if shard < 100 and name == "long":
        shard = 400
    assert trie(spark, convs, shard) == brute(convs)


def test_an_end_longer_than_a_piece_and_over_shards(spark):
    convs = {i: [("u", "x")] for i in range(0, 9000, 3)}
    assert trie(spark, convs, 1000) == brute(convs)


def test_query_and_cases(spark, tmp_path):
    rows = [(0, None, "u", "first"), (0, 2, "u", "third"), (0, 1, None, "second"), (0, 2, "a", "tie"), (0, 2, "a", "tie"), (3, 0, "u", None),
            (4, 5, "u", "own"), (4, 6, "u", "more"), (4, 7, "u", "end"), (6, 0, "u", "no base"), (7, 1, "", ""), (None, 1, "u", "nobody"), (10, 1, "u", "first"), (12, 1, "u", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("clash")).withColumn("h", F.lit("clash"))
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    said: dict[int, list] = {}
    for c, turn, role, text in rows:
        if c is not None:
            said.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    plain = {c: [(r, x) for *_, r, _, x in sorted(v)] for c, v in said.items()}
    built = {}
    for c, own in plain.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = plain.get(c - c % 5, [])[:h] + own[h:]
    got = sorted((tuple(r[n] for n in NAMES) for r in queries.op12_conversation_trie(spark, str(tmp_path)).collect()), key=str)
    assert got == brute(built)
    none = df.limit(0)
    none.write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert queries.op12_conversation_trie(spark, f"{tmp_path}/none").count() == 0


def test_shared_paths_stay_few():
    """A row of a shard without equals at its edges shares no node but the root."""
    import pyarrow as pa

    lead = ["".join(f"{i:016x}" for i in (a, b)) for a in range(5) for b in range(2)]
    ids = [b"".join(bytes.fromhex(x[k:k + 16]) * 2 for k in (0, 16)) for x in lead]
    n = len(lead)
    zero = pa.array([0] * n, pa.int64())
    t = pa.table({"conv": pa.array(range(n), pa.int64()), "block": zero, "ids": pa.array(ids, pa.binary()), "ns": pa.array([[1, 1]] * n, pa.list_(pa.int64())),
                  "lead": lead, "length": pa.array([2] * n, pa.int64()), "w": zero, **{f"b{k}": zero for k in range(4)}})
    s = ct._Shard(t)
    assert s.upto.tolist() == [64, 1, 0, 0, 0, 0, 0, 0, 1, 64]
    starts = {j: len(st) for j, _, st, _, _ in s.levels()}
    assert starts == {-1: 1, 0: 5, 1: 10}
