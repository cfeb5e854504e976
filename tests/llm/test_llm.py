"""Operators against brute force, round trips and held-out accuracy, and the cases their docstrings define."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from termlens.llm import (bm25_search, chat_formatting, ctw_model, embedding_dedup, jaccard_join, lm_scoring, mixing, quality_classifier,
                          queries, sentencepiece_codec, token_counts, toxicity)
from termlens.llm.hnsw import Graph

SF = "/root/testdata/sf0.001"
ODD = [(1, "The cat sat on the mat and the dog sat on the log", "a"), (2, "The cat sat on the mat and the dog sat on the log", "a"),
       (3, None, None), (4, "", "b"), (5, "  \n ", "b"), (None, "one two", "b"), (6, "x" * 30000 + " y", "a"), (1, "The cat sat", "a")]
SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumn("score", F.lit("clash")).withColumn("size", F.lit("clash"))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_ctw(train: list[bytes], text: bytes) -> float:
    """log10 probability by recursion over contexts, straight from the definition."""
    depth, seen = ctw_model.DEPTH, {}
    for t in train:
        s = b"\n" * depth + t
        for i in range(depth, len(s)):
            for d in range(depth + 1):
                for b in range(8):
                    seen.setdefault((s[i - d:i], b, s[i] >> (8 - b)), [0, 0])[s[i] >> (7 - b) & 1] += 1
    kt = lambda n: sum(math.lgamma(x + 0.5) - math.lgamma(0.5) for x in n) - math.lgamma(sum(n) + 1)
    weighted = {}
    for ctx, b, p in sorted(seen, key=lambda k: -len(k[0])):
        e = kt(seen[ctx, b, p])
        if len(ctx) < depth:
            kids = sum(weighted.get((bytes([c]) + ctx, b, p), 0.0) for c in range(256))
            weighted[ctx, b, p] = np.logaddexp(e, kids) - math.log(2)
        else:
            weighted[ctx, b, p] = e
    s, total = b"\n" * depth + text, 0.0
    for i in range(depth, len(s)):
        for b in range(8):
            bit, q = s[i] >> (7 - b) & 1, None
            path = [(s[i - d:i], b, s[i] >> (8 - b)) for d in range(depth + 1)]
            for node in reversed(path):
                if node in seen:
                    n = seen[node]
                    own = (n[bit] + 0.5) / (sum(n) + 1)
                    w = 1.0 if q is None else math.exp(kt(n) - math.log(2) - weighted[node])
                    q = own if q is None else w * own + (1 - w) * q
            total += math.log10(0.5 if q is None else q)
    return total


def test_ctw_equals_the_definition(spark):
    texts = ["the cat sat", "the dog sat", "a cat", "the cow ran", ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.id: r for r in lm_scoring.score(rows, "doc_id", "text", F.col("doc_id") < 3).collect()}
    stream = [" ".join(t.split()).encode() + b"\n" for t in texts]
    for i, s in enumerate(stream):
        assert got[i].score == pytest.approx(brute_ctw(stream[:3], s), rel=1e-5), i
    counts = Counter(w for t in texts[:3] for w in [*t.split(), None])
    for i, t in enumerate(texts):
        tokens = [*t.split(), None]
        assert got[i].base == pytest.approx(sum(math.log10((counts[w] + 1) / (sum(counts.values()) + len(counts) + 1)) for w in tokens))
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(tokens), sum(w in counts for w in tokens), 11)


def test_ctw_odd_rows(odd, none):
    assert lm_scoring.score(odd, "doc_id", "text", F.lit(True)).count() == len(ODD)
    assert lm_scoring.score(none, "doc_id", "text", F.lit(True)).count() == 0


def test_mixing(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    placed, sources = mixing.pieces(docs, "doc_id", "text", "source")
    got = mixing.taken(placed, mixing.mix(placed, sources, "source"), sources, "source").toPandas()
    assert len(got) == docs.count() and (got.taken <= 3 * got["size"]).all()
    by = got.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert (abs(by.taken - by.target) <= mixing.BLOCK * 3).all()
    mixed = mixing.mixed_documents(odd, "doc_id", "text", "source")
    assert mixed.columns == odd.columns and mixed.where("text = ''").count() == 0
    assert mixing.mixed_documents(none, "doc_id", "text", "source").count() == 0


def test_permutation():
    for n in (1, 2, 5, 64, 100):
        got = mixing._feistel(np.arange(n), np.full(n, n), np.full(n, 7, dtype=np.uint64))
        assert sorted(got) == list(range(n))


def test_water_filling(spark):
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame([("a", 10), ("b", 100), (None, 90)], "source string, source_size long")).collect()}
    assert got == pytest.approx({"a": 30, "b": 170 * 2 / 3, None: 170 / 3})  # a stops at 3 x 10, the rest is shared 2 : 1


def test_classifiers(spark, odd, none):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    truth = labels.toPandas().set_index("doc_id")
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    for module, label, least in ((quality_classifier, "quality", 0.9), (toxicity, "toxic", 0.93)):
        model = module.fit(docs, labels, "doc_id", "text", label, train)
        got = module.scored(docs, model, "text").select("doc_id", "score", "predicted").toPandas().set_index("doc_id")
        held = [i for i in truth.index if zlib.crc32(str(i).encode()) % 4 == 2]
        assert (got.predicted[held] == truth[label][held]).mean() >= least
        out = module.scored(odd, model, "text").toPandas()
        assert len(out) == len(ODD) and out.score.between(0, 1).all()
        assert module.scored(none, model, "text").count() == 0
        empty = module.fit(none, labels, "doc_id", "text", label, F.lit(True))
        assert module.scored(odd, empty, "text").first().score == 0.5


def test_crf_marginals_by_enumeration():
    crf = toxicity.Crf(3)
    crf.theta = np.array([0.3, -1.2, 2.0, -0.5, 0.4, 0.9, 0.2])
    numbers, lengths = np.array([0, 1, 2, 2, 1, 0, 2]), np.array([4, 0, 3])
    got, at = crf.marginals(numbers, lengths), 0
    for n in lengths:
        weights = Counter()
        for y in itertools.product((0, 1), repeat=int(n)):
            s = sum(crf.theta[numbers[at + k]] * y[k] for k in range(n)) + (crf.theta[6] * y[0] if n else 0)
            s += sum({(0, 1): crf.theta[3], (1, 0): crf.theta[4], (1, 1): crf.theta[5]}.get(p, 0) for p in zip(y, y[1:]))
            weights[y] = math.exp(s)
        for k in range(n):
            assert got[at + k] == pytest.approx(sum(w for y, w in weights.items() if y[k]) / sum(weights.values()))
        at += n


def brute_components(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    low = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(sets, 2):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y) and low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                changed = True
    return {i: (len(s), low[i]) for i, s in sets.items()}


def test_jaccard_join(spark, odd, none):
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in rng.integers(0, 400, 150)]
    rows = [(100, " ".join(base)), (101, " ".join(base))]
    for i in range(60):  # edits that end up on both sides of the threshold, some sharing a passage only
        words = list(base) if i < 45 else base[:60] + [f"z{k}" for k in rng.integers(0, 400, 80)]
        for at in rng.integers(0, len(words), int(rng.integers(0, 7))):
            words[at] = f"q{rng.integers(0, 1000)}"
        rows.append((i, " ".join(words[:int(rng.integers(8, len(words)))] if i % 5 == 0 else words)))
    rows += [(200, ""), (201, None), (202, "one two"), (203, "One  two"), (204, "one two three")]
    for n, percent in ((4, 85), (5, 80)):
        got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", n, percent).collect()
        assert {r.id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, n, percent)
    assert jaccard_join.near_duplicates(odd, "doc_id", "text").count() == len(ODD)
    kept = jaccard_join.representatives(odd, "doc_id", "text")
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 1
    assert jaccard_join.near_duplicates(none, "doc_id", "text").count() == 0


def test_search(spark, odd, none):
    got = bm25_search.search(odd, "doc_id", "text", odd.where("doc_id = 1"), "doc_id", "text").collect()
    assert {r.id for r in got} == {1, 2} and min(r["rank"] for r in got) == 1
    assert bm25_search.search(none, "doc_id", "text", none, "doc_id", "text").count() == 0


def test_codec(spark, odd, none):
    sp = pytest.importorskip("sentencepiece")
    model = open(queries.tokenizer_path("piece_bpe_32k.model"), "rb").read()
    library, codec = sp.SentencePieceProcessor(model_proto=model), sentencepiece_codec.Codec.of_file(model)
    for text in ["", "Hello  world\n\tfoo  ", "naïve 漢字 😀 ////----", "aaaa    bbbb", " x", *[t for _, t, _ in ODD if t]]:
        assert codec.encode(text) == library.encode(text) and codec.decode(codec.encode(text)) == text
    unigram = sentencepiece_codec.Codec([("<unk>", 0, "unknown"), ("▁", -1, "normal"), ("a", -2, "normal"), ("ab", -1.5, "normal"), ("b", -3, "normal"), ("▁a", -2.9, "normal")], "unigram")
    assert unigram.encode("ab") == [1, 3]
    out = sentencepiece_codec.decoded(sentencepiece_codec.encoded(odd, "text", model), "ids", model).collect()
    assert all(r.decoded == r.text for r in out)
    assert sentencepiece_codec.encoded(none, "text", model).count() == 0


def test_graph_and_embeddings(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 16))
    x[700:900] = x[3] + 0.03 * rng.normal(size=(200, 16))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    truth = (unit @ unit.T >= 0.98).sum()
    graph = Graph.restored(unit, Graph(unit).packed())
    q, _ = embedding_dedup.search_shard(graph, unit, unit, 0.98)
    assert 0.97 * truth <= len(q) <= truth
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], 2), (5, None, 1), (6, [0.0, 0.0], 1), (7, [float("nan"), 1.0], 1),
            (8, [1.0, 0.0], None), (9, [1.0], 1), (10, [None, 1.0], 1), (11, [], 1)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, e array<float>, label int"), "vec_id", "e", "label").collect()
    assert {r.id: (r.n_links, r.component_id) for r in got} == {i: (2, 1) if i < 4 else (0, i) for i in range(1, 12)}


def test_chat(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 3, "ann", "bye"), (2, 0, None, "alone"), (None, 0, "x", "y"), (3, 0, "system", "s")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.speaker, r.part): r for r in chat_formatting.perspectives(df, part_turns=3).collect()}
    assert set(got) == {(1, "ann", 0), (1, "ann", 1), (1, "bob", 0), (1, "bob", 1), (2, "unknown", 0)}
    ann = got[1, "ann", 0]
    assert ann.text.startswith("<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi < |im_end|><|im_end|>\n<|im_start|>user name=bob\n<|im_end|>")
    assert [ann.text[m.start:m.end] for m in ann.mask] == ["hi < |im_end|><|im_end|>"]
    assert got[1, "bob", 1].mask == [] and chat_formatting.perspectives(df.where("false")).count() == 0


def test_token_counts(spark, odd, none):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.tokenizer_path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    texts = ["it's ΣΑΣ <|endoftext|>x", "É é\x1cq", "", "İstanbul 123 !?"]
    rows = odd.select("text").unionByName(spark.createDataFrame([(t,) for t in texts], "text string"))
    for r in token_counts.count_tokens(rows, "text", path).collect():
        assert r.n_tokens == len(library.encode(r.text or "", add_special_tokens=False).ids)
    assert token_counts.count_tokens(none, "text", path).count() == 0


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert 0 < out.doc_id.nunique() <= docs.count() and (out.n_pieces == out.ids.map(len)).all()
    assert isinstance(out, pd.DataFrame) and out.groupby("doc_id").size().max() <= mixing.MOST


def test_sentencepiece_columns_equal_single_runs():
    """Runs coded together, by columns, get the ids of runs coded one at a time, for both kinds of model."""
    import random

    from termlens.llm.sentencepiece_codec import LONGEST, Codec

    r = random.Random(3)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randrange(1, 6))) for _ in range(80)} | {"a", "b", "c"})
    pieces = [("<unk>", 0.0, "unknown"), *[(f"<0x{b:02X}>", 0.0, "byte") for b in range(256)],
              *[(w, -float(i), "normal") for i, w in enumerate(sorted(words, key=len, reverse=True))]]
    texts = ["", "a", "a" * LONGEST, "ab" * LONGEST] + ["".join(r.choice("abcdé") for _ in range(r.randrange(1, 70))) for _ in range(500)]
    for kind in ("bpe", "unigram"):
        together, alone = Codec(pieces, kind), Codec(pieces, kind)
        short = [t for t in texts if 0 < len(t) <= LONGEST]
        assert together.columns.code(short) == [alone.run(t) for t in short]
        assert together.encode_all([None, *texts, *texts]) == [None, *[alone.encode(t) for t in texts * 2]]


def test_mixed_documents_keep_white_space(spark):
    """Documents taken whole come out unchanged; parts are made of the original's words with the white space behind."""
    texts = ["a b\n\n  c\td\r\n", "\n\tindented  twice\n", "one", " x\x0by\x0c z\x1cq\u00a0r ", "\n".join(f"line {i}\t{'#' * (i % 5)}  end" for i in range(200)), " \n ", "", None]
    docs = spark.createDataFrame([(i, t, "only", 0) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_chars int")
    got = {r.doc_id: r for r in mixing.mixed_documents(docs, "doc_id", "text", "source", "n_chars").collect()}
    assert {i: r.text for i, r in got.items()} == {i: t for i, t in enumerate(texts) if t and t.strip()}
    assert all(r.n_chars == len(r.text) for r in got.values())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    original, parts = {r.doc_id: r.text for r in docs.collect()}, 0
    for r in mixing.mixed_documents(docs, "doc_id", "text", "source", "n_chars").collect():
        text = original[r.doc_id]
        whole = len(word_list(r.text)) == len(word_list(text))
        assert r.text == text if whole else r.text != text
        slices = iter(re.findall(r"(?:\A[ \t-\r]+)?[^ \t-\r]+[ \t-\r]*", text))
        assert all(s in slices for s in re.findall(r"(?:\A[ \t-\r]+)?[^ \t-\r]+[ \t-\r]*", r.text))  # in order
        parts += not whole
    assert parts


def word_list(text):
    return re.findall(r"[^ \t-\r]+", text)


def test_audit_measures_nearest_neighbours():
    """A graph that reaches nothing fails its audit even if no audit query has a link."""
    rng = np.random.default_rng(8)
    unit = rng.normal(size=(3000, 16))
    unit[2000] = unit[1] + 0.01 * rng.normal(size=16)  # the only link; neither of the two is an audit query
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    queries, own = unit[:1000], np.arange(1000)
    audit = np.linspace(0, 999, embedding_dedup.AUDIT).astype(int)
    assert 1 not in audit
    graph = Graph(unit)
    graph.layers[0][1][:] = -1
    q, n = embedding_dedup.search_shard(graph, unit, queries, 0.98, own)
    assert {(a, b) for a, b in zip(q, n) if a != b} == {(a, b) for a, b in np.argwhere(queries @ unit.T >= 0.98) if a != b} != set()


class Lossy:
    """Exact neighbours, but half of them are lost at beam 192."""

    def __init__(self, unit):
        self.x = unit.astype(np.float32)

    def search(self, q, beam, extra=0):
        sims = q @ self.x.T
        ids = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
        sims = np.take_along_axis(sims, ids, 1)
        if beam == 192:
            ids[:, ::2], sims[:, ::2] = -1, -2.0
        return ids, sims


def test_repeated_queries_are_audited():
    """In a shard too large for products at beam 192, a walk that loses links of repeated queries widens."""
    rng = np.random.default_rng(9)
    unit = rng.normal(size=(6500, 16))
    unit[100:200] = unit[100] + 0.01 * rng.normal(size=(100, 16))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    assert 4 * embedding_dedup.BEAM * embedding_dedup.WIDE < len(unit)
    q, _ = embedding_dedup.search_shard(Lossy(unit), unit, unit[:1000], 0.98, np.arange(1000))
    assert len(q) == (unit[:1000] @ unit.T >= 0.98).sum()


def test_frequent_pre_tokens_of_all_documents(spark):
    """The table's pre-tokens come from whole texts of all rows; the bounded summary keeps what is frequent."""
    tokenizer = open(queries.tokenizer_path("word_bpe_49k.json"), encoding="utf-8").read()
    rows = [("early words",)] * 2500 + [("late zebra's " * 2,)] * 500 + [("x " * 6000 + "behind " * 400,), (None,), ("",), ("Q\x1cq <|endoftext|>",)]
    texts = spark.createDataFrame(rows, "text string").coalesce(1)
    table = token_counts.frequent_table(texts, "text", tokenizer)
    assert set(table) == {"early", "words", "late", "zebra", "'s", "x", "behind", "q", "\x1c"}
    lengths = token_counts.Lengths(tokenizer, {})
    assert lengths.pre_tokens(["late zebra's " * 2, "Q\x1cq <|endoftext|>"]) == {"late": 2, "zebra": 2, "'s": 2, "q": 2, "\x1c": 1}
    counts = Counter()
    for lo in range(0, 5000, 50):
        counts.update({f"rare {k}": 1 for k in range(lo, lo + 50)} | {"often": 20})
        counts = token_counts.thinned(counts, 100)
    assert len(counts) <= 100 and 2000 - 7000 / 100 <= counts["often"] <= 2000


def test_table_is_cut_by_count(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "TABLE", 5)
    tokenizer = open(queries.tokenizer_path("word_bpe_49k.json"), encoding="utf-8").read()
    texts = spark.createDataFrame([("a a a b b b c c d d e e f f g",)], "text string")
    table = token_counts.frequent_table(texts, "text", tokenizer)
    assert len(table) == 5 and {"a", "b"} < set(table) < set("abcdef")


def test_search_finds_matches_of_common_words_only(spark):
    """A word that is in every one of 20,000 documents scores 2.5e-5, which is above 0 after rounding."""
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"))
    got = bm25_search.search(docs, "doc_id", "text", docs.where("doc_id = 7"), "doc_id", "text").collect()
    score = round(math.log1p(0.5 / 20000.5), 6)
    assert score > 0 and sorted((r["rank"], r.id, r.score) for r in got) == [(i + 1, i, score) for i in range(10)]
    docs = docs.where("doc_id < 19999").unionByName(spark.createDataFrame([(20000, "other")], "doc_id long, text string"))
    assert bm25_search.search(docs, "doc_id", "text", docs.where("doc_id = 7"), "doc_id", "text").count() == 10


def test_last_comparison_runs_without_ring_pairs(spark, monkeypatch):
    """Linked pairs that no ring round brought together are found by the last comparison."""
    monkeypatch.setattr(jaccard_join, "ROUNDS", 0)
    base = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:59], "q"])), (3, " ".join(f"z{k}" for k in range(60))), (4, "one two")]
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 4, 85).collect()
    assert {r.id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 4, 85)
    assert {r.id: r.component_id for r in got}[2] == 1
