"""Text segmentation operators (T2-T9, T17, P14) on any (id, text) table.

Per-row work is array expressions on the text column (no shuffle); ``posexplode`` turns the arrays
into rows at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termlens.config import TaskMap
from termlens.functions import text as tx


def window_starts(n: Column, size: int, overlap: int) -> Column:
    """1-based starts of token windows of ``size`` advancing by ``size - overlap``; a window is added
    while the previous one ends before the last token. Empty input gives no window."""
    step = size - overlap
    count = F.when(n <= size, F.lit(1)).otherwise(1 + F.ceil((n - size) / F.lit(step)).cast("int"))
    starts = F.sequence(F.lit(1), 1 + (count - 1) * step, F.lit(step))
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(starts)


def _window_at(tokens: Column, size: int):
    return lambda s: F.array_join(F.slice(tokens, s, size), " ")


def windows(tokens: Column, size: int, overlap: int = 0) -> Column:
    """Token windows re-joined with spaces."""
    return F.transform(window_starts(F.size(tokens), size, overlap), _window_at(tokens, size))


# ---- fixed value: bytes of text a task cuts into n-grams and counts (some 40 times as much) ----
TEXT_PER_TASK = 4 << 20
# -------------------------------------------------------------------------------------------


def dealt_out(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, text)`` dealt out by id to as many tasks as the texts' bytes ask for, which AQE does not merge."""
    n_bytes = df.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    n_parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // TEXT_PER_TASK))
    return df.select(id_col, text_col).repartition(n_parts, id_col)


def word_ngram_counts(df: DataFrame, id_col: str, text_col: str, n_min: int = 1, n_max: int = 3) -> DataFrame:
    """T2+T3+T4+V1: ``(id, term, type, tf)``; no stop-word removal. Texts are shuffled, not their n-grams: these are counted where
    an id's texts are."""
    df = dealt_out(df, id_col, text_col)
    w = df.select(F.col(id_col), tx.words(text_col).alias("_w"))
    grams = w.select(id_col, F.explode_outer(tx.ngrams("_w", n_min, n_max)).alias("term")).where(F.col("term").isNotNull())
    return (grams.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))
            .withColumn("type", tx.ngram_type("term")))


def token_windows(df: DataFrame, id_col: str, text_col: str, size: int = 512, overlap: int = 0) -> DataFrame:
    """``(id, segment, n_tokens, text)`` - word tokens cut into windows of ``size``."""
    toks = df.select(F.col(id_col), tx.words(text_col).alias("_t"))
    segs = toks.select(id_col, F.size("_t").alias("_n"), windows(F.col("_t"), size, overlap).alias("_s"))
    return segs.select(id_col, F.posexplode("_s").alias("segment", "text"), "_n").select(
        id_col, "segment", F.size(F.split("text", " ")).alias("n_tokens"), "text")


def sentences(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, sent_idx, sentence)``."""
    s = df.select(F.col(id_col), tx.sentence_split(text_col).alias("_s"))
    return s.select(id_col, F.posexplode("_s").alias("sent_idx", "sentence"))


SPAN_LIMIT = 400
SPAN_SIZE = 128
SPAN_OVERLAP = 20


def section_name(section: Column) -> Column:
    """Section name up to the first ``-``, ``_`` or ``text`` (any case), trimmed."""
    return F.trim(F.element_at(F.split(section, "(?i)(-|_|text)"), 1))


def _prefixed(name: Column):
    def per_sentence(s):
        spans = windows(F.split(s, r"\s+"), SPAN_SIZE, SPAN_OVERLAP)
        return F.when(F.length(s) > SPAN_LIMIT, F.transform(spans, lambda sp: F.concat(name, F.lit(": "), sp))) \
            .otherwise(F.array(F.concat(name, F.lit(": "), s)))
    return per_sentence


def sectioned_sentences(df: DataFrame, id_cols: list[str], text_col: str, section_col: str) -> DataFrame:
    """Per line, rule-based sentences prefixed with ``"<section>: "``; sentences over 400 characters
    become overlapping spans of 128 whitespace tokens (overlap 20)."""
    name = section_name(F.col(section_col))
    sents = F.flatten(F.transform(F.split(F.col(text_col), "\n"),
                                  lambda ln: tx.sentence_split(F.trim(ln))))
    staged = df.select(*id_cols, name.alias("_name"), sents.alias("_s"))
    out = staged.select(*id_cols, F.flatten(F.transform("_s", _prefixed(F.col("_name")))).alias("_p"))
    return out.select(*id_cols, F.posexplode("_p").alias("sent_idx", "sentence"))


def zipped_sections(df: DataFrame, id_cols: list[str], text_col: str, sections_col: str, carry: bool = True) -> DataFrame:
    """T9 on whole texts: line ``i`` of a text belongs to name ``i`` of its array of section names; sentences of a line are
    prefixed with its name, long ones cut into spans. Names beyond the lines are unused; lines beyond the names carry
    the last name on, or are left out without ``carry``. No names: no rows."""
    names = F.transform(F.col(sections_col), section_name)
    staged = df.where(F.size(sections_col) > 0).select(*id_cols, names.alias("_names"), F.split(F.col(text_col), "\n").alias("_lines"))
    lines = F.col("_lines") if carry else F.slice("_lines", 1, F.size("_names"))

    def per_line(ln, i):
        return F.flatten(F.transform(tx.sentence_split(F.trim(ln)), _prefixed(F.element_at("_names", F.least(i + 1, F.size("_names"))))))

    out = staged.select(*id_cols, F.posexplode(F.transform(lines, per_line)).alias("line", "_p"))
    return out.select(*id_cols, "line", F.posexplode("_p").alias("sent_idx", "sentence"))


def label_profile(samples: DataFrame, tasks: TaskMap) -> DataFrame:
    """Per split and task: rows, distinct labels, and the count of each label. One scan and one exchange of counts; the
    totals are a window over a row per split, task and label."""
    labels = F.array(*[F.struct(F.lit(t).alias("task"), F.col(t).cast("int").alias("label")) for t in tasks.names])
    per_label = (samples.select("split", F.inline(labels)).groupBy("split", "task", "label").agg(F.count(F.lit(1)).alias("n")))
    whole = Window.partitionBy("split", "task")
    return per_label.select("split", "task", "label", "n", F.sum("n").over(whole).alias("n_rows"),
                            F.count(F.lit(1)).over(whole).alias("n_distinct"))


def cleaned(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Punctuation padded with spaces, whitespace squeezed."""
    return df.select(id_col, tx.clean_text(text_col).alias("text"))
