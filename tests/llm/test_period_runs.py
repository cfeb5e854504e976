"""Periodic runs against the definition, and the cases the docstring defines."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from termlens.llm import period_runs, queries


def brute(words: list, least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, from the definition: for each period the stretches that keep it and that
    no neighbour extends, without those that keep a smaller one."""
    out = []
    for q in range(1, len(words) // 2 + 1):
        i = q
        while i < len(words):
            if words[i] != words[i - q]:
                i += 1
                continue
            e = i
            while e < len(words) and words[e] == words[e - q]:
                e += 1
            s, n = i - q, e - i + q
            if n >= max(least, 2 * q) and not any(all(words[k] == words[k - p] for k in range(s + p, e)) for p in range(1, q)):
                out.append((s, n, q))
            i = e
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept(words: list, runs) -> list:
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def portion(texts, least=12):
    return list(period_runs._portion([t if t is None else t.encode() for t in texts], least))


def some_texts():
    rng = random.Random(5)
    yield from (" ".join(rng.choice("ab") for _ in range(n)) for n in range(0, 200, 7))
    yield from (" ".join(rng.choice("abc") for _ in range(60)) for _ in range(20))
    yield from ("a " * n for n in (1, 11, 12, 13, 100))
    a, b = "a", "ab"
    while len(b) < 300:
        a, b = b, b + a
    yield " ".join(b)  # Fibonacci word: nested runs of many periods
    t = "a"
    while len(t) < 256:
        t += t.translate(str.maketrans("ab", "ba"))
    yield " ".join(t)  # Thue-Morse word: the classic trap of hashes modulo a power of two
    for _ in range(40):
        unit = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 40))]
        yield " ".join([rng.choice("xyz") for _ in range(rng.randint(0, 9))] + unit * rng.randint(1, 6) + unit[:rng.randint(0, len(unit))]
                       + [rng.choice("xyz") for _ in range(rng.randint(0, 9))] + unit * 2)


@pytest.mark.parametrize("least", [12, 4, 5, 2])
def test_runs_equal_the_definition(least):
    texts = list(some_texts())
    for text, (runs, collapsed) in zip(texts, portion(texts, least)):
        want = brute(text.split(), least)
        assert runs == want, text
        assert collapsed.decode() == " ".join(kept(text.split(), want))


def test_blocks_of_pairs(monkeypatch):
    texts = list(some_texts())
    want = portion(texts)
    monkeypatch.setattr(period_runs, "PAIRS", 3)
    assert portion(texts) == want


def test_a_lying_hash_is_found_out(monkeypatch):
    texts = ["p q r s t u v w p q r s t u x w " * 3, "a b c d e f " * 5]
    real, calls = period_runs._stretches, []

    def lying(ids, doc, least, salt):
        calls.append(salt)
        s, e, q = real(ids, doc, least, salt)
        return (s, e + 1, q) if salt == 0 else (s, e, q)

    monkeypatch.setattr(period_runs, "_stretches", lying)
    assert [r for r, _ in portion(texts)] == [brute(t.split()) for t in texts] and calls == [0, 1]


def test_nothing_crosses_texts_and_words_split_at_ascii_space_only():
    line = "one two three four five six"
    assert [r for r, _ in portion([line, line, line])] == [[], [], []]
    odd = " ".join(["a b", "c d"] * 6)
    assert portion([odd])[0] == ([(0, 12, 2)], "a b c d".encode())


def test_long_text_opens_each_diagonal_once():
    n = 30_000
    ids = np.concatenate([[-1], np.zeros(n, dtype=np.int64)])
    opened = sum(len(a) for a, _ in period_runs._opened(ids, np.zeros(n + 1, np.int64), period_runs.mixed(ids.astype(np.uint64)), 6))
    assert opened < n  # not n * n / 2
    assert [x.tolist() for x in period_runs.find_runs(ids, np.zeros(n + 1, np.int64))] == [[1], [n], [1]]


def test_cases_and_clashing_columns(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "a b " * 8), (4, "a b " * 8), (None, "x " * 12), (5, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit("clash")).withColumn("id", F.lit("clash"))
    got = sorted(((r.id, [tuple(x) for x in r.runs], r.collapsed) for r in period_runs.collapse_runs(df, "doc_id", "text").collect()), key=str)
    run = [(0, 16, 2)]
    assert got == sorted([(1, [], ""), (2, [], ""), (3, [], ""), (4, run, "a b"), (4, run, "a b"), (None, [(0, 12, 1)], "x"), (5, [], "y")], key=str)
    assert period_runs.collapse_runs(df.limit(0), "doc_id", "text").count() == 0


def test_query_against_the_definition(spark):
    got = {r.doc_id: r for r in queries.op13_period_runs(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc_id, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 1500:
            continue  # the definition walked in plain Python takes too long
        runs = brute(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        r = got[doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(kept(words, runs)).encode()).hexdigest()
