"""Operator 9: chat formatting by perspective rotation (DataFrame functions only).

Every participant of a conversation gets the whole dialogue rendered from their side: their own turns as
``assistant``, everyone else's as ``user`` with a name, system turns unchanged. The mask marks what a model
trained on that perspective learns: the text and the end mark of the speaker's own turns.

A dialogue is rendered in parts of ``part_turns`` turns in (turn, role, md5 of the text) order. Part 0 is the
whole dialogue for all but very long ones; a conversation of any length, hot ones included, never meets in
one task, because ranks are taken over range-partitioned pieces and parts are bounded.

Defined cases: a null text renders as empty; a null or empty role speaks as ``unknown``; turns without a
conversation id belong to no dialogue and give no rows; repeated turns are rendered each; a conversation of
system turns only has no participant and no rows. The marks ``<|`` inside texts and names are broken up as
``< |``, so no text can forge a turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlens.llm.common import numbered

# ---- fixed values: the template ----
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"
UNKNOWN = "unknown"
# ------------------------------------


def perspectives(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 part_turns: int = 64) -> DataFrame:
    """(conv_id, speaker, part, n_turns, n_own, text, mask): one row per conversation, participant and part.

    ``mask`` is an array of (start, end) character offsets into ``text``, end exclusive."""
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    said = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).alias("c"), F.col(turn).alias("t"),
        safe(F.coalesce(F.nullif(F.col(role), F.lit("")), F.lit(UNKNOWN))).alias("r"),
        safe(F.coalesce(F.col(text), F.lit(""))).alias("x")).withColumn("h", F.md5("x"))
    ranked = numbered(said, ["c"], ["t", "r", "h"], name="chat-turns").select(
        "c", "r", "x", "before", F.floor(F.col("before") / part_turns).alias("part"))
    people = ranked.where(F.col("r") != SYSTEM).select(F.col("c").alias("pc"), F.col("r").alias("speaker")).distinct()
    seen = ranked.join(people, F.col("c") == F.col("pc")).drop("pc")
    own = F.col("r") == F.col("speaker")
    head = F.concat(F.lit(OPEN), F.when(own, F.lit("assistant")).when(F.col("r") == SYSTEM, F.lit(SYSTEM))
                    .otherwise(F.concat(F.lit("user name="), F.col("r"))), F.lit("\n"))
    message = F.struct(F.col("before").alias("k"), own.alias("own"), head.alias("head"), F.concat("x", F.lit(CLOSE)).alias("body"))
    parts = seen.groupBy("c", "speaker", "part").agg(F.sort_array(F.collect_list(message)).alias("m"))
    whole = F.concat_ws("", F.transform("m", lambda m: F.concat(m.head, m.body, F.lit("\n"))))
    # (offset so far, spans): every message moves the offset by its length and, if own, adds a span
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    step = lambda acc, m: F.struct(
        (acc.at + F.length(m.head) + F.length(m.body) + 1).alias("at"),
        F.when(m.own, F.concat(acc.spans, F.array(F.struct(
            (acc.at + F.length(m.head)).alias("start"), (acc.at + F.length(m.head) + F.length(m.body)).alias("end")))))
        .otherwise(acc.spans).alias("spans"))
    return parts.select(
        F.col("c").alias("conv_id"), "speaker", "part", F.size("m").cast("long").alias("n_turns"),
        F.size(F.filter("m", lambda m: m.own)).cast("long").alias("n_own"), whole.alias("text"),
        F.aggregate("m", start, step, lambda acc: acc.spans).alias("mask"))
