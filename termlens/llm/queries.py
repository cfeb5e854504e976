"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termlens.llm import bm25_search, chat_formatting, conversation_trie, embedding_dedup, jaccard_join, lm_scoring, mixing, period_runs, quality_classifier, sentencepiece_codec, token_counts, toxicity, warc_packages
from termlens.llm.common import crc_bucket, table, words
from termlens.session import scratch_path


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = lm_scoring.score(docs, "doc_id", "text", crc_bucket("doc_id", 7) != 2)
    return out.select(F.col("id").alias("doc_id"), (crc_bucket("id", 7) == 2).alias("held_out"), "n_tokens", "n_known",
                      "train_tokens", F.col("base").alias("base_score"), "score", "code_length")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    placed, sources = mixing.pieces(docs, "doc_id", "text", "source")
    placed = placed.drop("text")
    out = mixing.taken(placed, mixing.mix(placed, sources, "source"), sources, "source")
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_bucket("doc_id", 5) == 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "toxic", ~held_out)
    return toxicity.scored(docs, model, "text").select("doc_id", held_out.alias("held_out"), "score", "predicted",
                                                       F.size("spans").alias("n_spans"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_bucket("doc_id", 4) == 2
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "quality", ~held_out)
    return quality_classifier.scored(docs, model, "text").select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.near_duplicates(docs, "doc_id", "text", n=4, percent=85).withColumnRenamed("id", "doc_id")


def op6_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bm25_search.search(docs, "doc_id", "text", docs.where("doc_id % 50 = 0"), "doc_id", "text", k=10).withColumnRenamed("id", "doc_id")


OP6_SQL = """
WITH w AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\\x20\\x09-\\x0D]+')) AS t
  FROM documents),
tf AS (SELECT doc_id, t, count(*) AS tf FROM w GROUP BY doc_id, t),
len AS (SELECT d.doc_id, coalesce(sum(tf.tf), 0) AS dl FROM documents d LEFT JOIN tf ON tf.doc_id = d.doc_id GROUP BY d.doc_id),
tot AS (SELECT count(*) AS n, avg(dl) AS mean FROM len),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
s AS (
  SELECT q.doc_id AS query_id, tf.doc_id,
         sum(q.tf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf.tf * 2.2 / (tf.tf + 1.2 * (1 - 0.75 + 0.75 * dl / mean))) AS exact
  FROM tf q JOIN tf ON tf.t = q.t JOIN df ON df.t = q.t JOIN len ON len.doc_id = tf.doc_id CROSS JOIN tot
  WHERE q.doc_id % 50 = 0 GROUP BY q.doc_id, tf.doc_id)
SELECT query_id, rank::INT AS rank, doc_id, round(exact, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(exact, CAST(11 - floor(log10(exact)) AS INTEGER)) DESC, doc_id) AS rank
  FROM s WHERE exact > 0)
WHERE rank <= 10
"""


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    with open(tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    out = sentencepiece_codec.round_trip(docs, "text", model)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids",
                      F.col("decoded").eqNullSafe(F.replace("text", F.lit("\u2581"), F.lit(" "))).alias("round_trip"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label").withColumnRenamed("id", "vec_id")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat_formatting.perspectives(table(spark, sf_dir, "conversations"))
    spans = F.concat_ws(",", F.transform("mask", lambda s: F.concat_ws("-", s.start.cast("string"), s.end.cast("string"))))
    return out.withColumn("mask", spans)


OP9_SQL = """
WITH said AS (
  SELECT conv_id, turn, replace(coalesce(nullif(role, ''), 'unknown'), '<|', '< |') AS r,
         replace(coalesce(text, ''), '<|', '< |') AS x
  FROM conversations WHERE conv_id IS NOT NULL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn ASC NULLS LAST, r, md5(x)) - 1 AS k FROM said),
seen AS (
  SELECT a.conv_id, p.speaker, a.k, a.k // 64 AS part, a.r = p.speaker AS own,
         '<|im_start|>' || CASE WHEN a.r = p.speaker THEN 'assistant' WHEN a.r = 'system' THEN 'system'
                           ELSE 'user name=' || a.r END || chr(10) AS head,
         a.x || '<|im_end|>' AS body
  FROM ranked a JOIN (SELECT DISTINCT conv_id, r AS speaker FROM ranked WHERE r <> 'system') p ON a.conv_id = p.conv_id),
placed AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (
    PARTITION BY conv_id, speaker, part ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM seen)
SELECT conv_id, speaker, part, count(*) AS n_turns, count(*) FILTER (WHERE own) AS n_own,
       string_agg(head || body || chr(10), '' ORDER BY k) AS text,
       coalesce(string_agg((pos + length(head)) || '-' || (pos + length(head) + length(body)), ',' ORDER BY k)
                FILTER (WHERE own), '') AS mask
FROM placed GROUP BY conv_id, speaker, part
"""


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, "text", tokenizer_path("word_bpe_49k.json")).drop("text")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc_packages.write(table(spark, sf_dir, "pages"), scratch_path(spark, f"llm/warc-{uuid.uuid4().hex}"), "page_id", "url", "html")
    out = warc_packages.records(spark, path, payloads=False)
    return out.select(F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                      F.col("refers_to").cast("long").alias("refers_to"))


OP11_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
r AS (SELECT page_id, h, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS f,
             row_number() OVER (PARTITION BY h ORDER BY page_id NULLS LAST) AS k FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                               1 + ((('0x' || substr(x, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31), 1)
                        FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN k > 1 THEN f END AS refers_to
FROM r
"""


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_trie.ordered(table(spark, sf_dir, "conversations"))
    c = F.col("conv")
    convs, rebuilt = conversation_trie.branched(turns, c - c % 5, crc_bucket("conv", 9), 8)
    return conversation_trie.prefix_trie(convs, rebuilt)


OP12_SQL = """
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) - 1 AS k
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT c, c - c % 5 AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
                         lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
                                                  lambda u, z: xor(u >> 1, 3988292384 * (u & 1)))), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT c FROM t)),
rebuilt AS (
  SELECT c.c, t.k + 1 AS d, r, x FROM c JOIN t ON t.c = c.base WHERE t.k < h
  UNION ALL
  SELECT c.c, least(h, (SELECT count(*) FROM t b WHERE b.c = c.base)) + t.k - h + 1, r, x FROM c JOIN t ON t.c = c.c WHERE t.k >= h),
paths AS (
  SELECT c, 0 AS d, 'root' AS key, 0 AS n FROM c
  UNION ALL
  SELECT c, d, md5(string_agg(md5(strlen(r) || ':' || r || x), '' ORDER BY d) OVER (PARTITION BY c ORDER BY d)), strlen(x) FROM rebuilt),
lens AS (SELECT c, max(d) AS len FROM paths GROUP BY c),
nodes AS (
  SELECT p.d, p.key, min(p.c) AS m, count(*) AS n, any_value(p.n) AS bytes,
         sha256(coalesce(string_agg(p.c::VARCHAR, ',' ORDER BY p.c) FILTER (WHERE len = p.d), '')) AS ends
  FROM paths p JOIN lens USING (c) GROUP BY p.d, p.key),
below AS (SELECT DISTINCT a.d, a.key, b.d AS bd, b.key AS bkey FROM paths a JOIN paths b ON a.c = b.c AND b.d >= a.d),
kids AS (SELECT d, key, count(*) FILTER (WHERE bd = d + 1) AS kids FROM below GROUP BY d, key),
sums AS (
  SELECT b.d, b.key, count(*) FILTER (WHERE k.kids = 0) AS leaves, sum((n.n - 1) * n.bytes) AS saved
  FROM below b JOIN nodes n ON n.d = b.bd AND n.key = b.bkey JOIN kids k ON k.d = b.bd AND k.key = b.bkey GROUP BY b.d, b.key),
up AS (SELECT b.bd AS d, b.bkey AS key, n.m FROM below b JOIN nodes n ON n.d = b.d AND n.key = b.key WHERE b.bd = b.d + 1)
SELECT n.m AS conv_id, n.d::BIGINT AS depth, up.m AS parent_conv_id, n.n AS n_convs, kids.kids AS n_children, leaves AS n_leaves,
       saved::BIGINT AS saved_tokens, ends AS ends_sha256
FROM nodes n JOIN kids USING (d, key) JOIN sums USING (d, key) LEFT JOIN up USING (d, key)
"""


def op13_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    text = F.when(h % 10 == 0, period_runs.tail_repeated(words(F.col("text")), F.floor(h / 10))).otherwise(F.coalesce("text", F.lit("")))
    docs = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    out = period_runs.collapse_runs(docs, "doc_id", "text").withColumn("best", period_runs.longest("runs"))
    line = lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))
    return out.select(F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                      F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
                      F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
                      F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_mixing": op2_mixing,
    "op3_toxicity": op3_toxicity,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_bm25_search": op6_bm25_search,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_token_counts": op10_token_counts,
    "op11_warc": op11_warc,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_period_runs": op13_period_runs,
}
ORACLES: dict[str, str] = {"op6_bm25_search": OP6_SQL, "op9_chat_formatting": OP9_SQL, "op11_warc": OP11_SQL,
                           "op12_conversation_trie": OP12_SQL}
