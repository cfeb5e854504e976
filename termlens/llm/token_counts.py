"""Operator 10: token counts by a two-tier, map-side lookup of pre-token lengths.

A text is normalised and cut into pre-tokens by the tokenizer file's rules; its count is the sum of the
pre-tokens' lengths in tokens, which do not depend on their neighbours. Tier 1 is a broadcast table of the
lengths of the most frequent pre-tokens of all texts (at most ``TABLE`` entries; it decides speed only, never a
count). Every partition counts its whole texts in a summary of bounded size, and only the summaries meet in a
grouped sum: no pre-token of the texts is shuffled. Misses are encoded by the library and kept in a bounded
cache that a worker carries from batch to batch (tier 2).

The tokenizer file must be byte-level BPE behind NFC, white-space and lower-case normalisation with a split
pattern (as ``word_bpe_49k.json``). Special strings inside texts count as the library counts them: one token
each, cut out before normalisation.

Defined cases: null and empty texts count 0 tokens and 0 bytes; a null id is kept; repeated rows are counted
each; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlens.llm.common import portions, written

TABLE = 1 << 16  # broadcast pre-tokens
SUMMARY = 1 << 16  # pre-tokens that a partition's summary keeps
CACHE = 1 << 18  # pre-tokens a worker keeps
LONGEST = 64  # longer pre-tokens are encoded anew each time
# ---- fixed values: white space and pre-tokens as the tokenizer file has them ----
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"
# ---------------------------------------------------------------------------------
ODD_SPACE = re.compile("[\x1c-\x1f]").search


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 letters stand for
    themselves, the other bytes take the letters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in plain]
    return {x: chr(x) for x in plain} | {x: chr(256 + i) for i, x in enumerate(rest)}


class Lengths(dict):
    """Pre-token -> number of tokens; misses are encoded, and kept while there is room."""

    def __init__(self, tokenizer: str, known: dict):
        from tokenizers import Tokenizer

        super().__init__(known)
        self.library = Tokenizer.from_str(tokenizer)
        self.tokenize = self.library.model.tokenize
        self.letters = byte_letters()
        self.room = len(known) + CACHE
        self.cut = regex.compile(PRE_TOKEN).findall
        special = [x["content"] for x in json.loads(tokenizer)["added_tokens"]]
        self.special = re.compile("|".join(re.escape(x) for x in sorted(special, key=len, reverse=True))) if special else None
        self.runs = _Runs(self)

    def __missing__(self, word: str) -> int:
        n = len(self.tokenize("".join(map(self.letters.__getitem__, word.encode()))))
        if len(word) <= LONGEST and len(self) < self.room:
            self[word] = n
        return n

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # letter by letter: no final sigma
        return text.lower()

    def pre_tokens(self, texts) -> Counter:
        """Counts of the pre-tokens of some texts; a run between white space is cut once."""
        counts, runs = Counter(), Counter()
        for text in texts:
            for piece in self.special.split(text) if self.special is not None and self.special.search(text) else [text]:
                piece = self.normal(piece)
                if ODD_SPACE(piece):
                    counts.update(self.cut(piece))
                else:
                    runs.update(piece.split())
        for run, n in runs.items():
            for word in self.cut(run):
                counts[word] += n
        return counts

    def piece(self, text: str) -> int:
        text = self.normal(text)
        if ODD_SPACE(text):  # str.split() also splits at these, the tokenizer doesn't
            return sum(map(self.__getitem__, self.cut(text)))
        return sum(map(self.runs.__getitem__, text.split()))

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self.piece(text)
        pieces = self.special.split(text)
        return len(pieces) - 1 + sum(map(self.piece, pieces))


class _Runs(dict):
    """Run of letters between white space -> number of tokens: no pre-token crosses white space, so a run that
    was met before needs no cutting. Bounded as the pre-tokens are."""

    def __init__(self, lengths: Lengths):
        super().__init__()
        self.lengths = lengths

    def __missing__(self, run: str) -> int:
        n = sum(map(self.lengths.__getitem__, self.lengths.cut(run)))
        if len(run) <= LONGEST and len(self) < CACHE:
            self[run] = n
        return n


_WORKER: dict = {}


def _lengths(table) -> Lengths:
    """The worker's own table, built once and kept from task to task."""
    tokenizer, known, key = table.value
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Lengths(tokenizer, known)
    return _WORKER[key]


def thinned(counts: Counter, most: int) -> Counter:
    """A frequent-items summary (Misra-Gries) of at most ``most`` entries: all counts are lowered by the first one
    beyond, so each is too low by at most the total of counts / ``most``, over all calls and merges."""
    if len(counts) <= most:
        return counts
    over = heapq.nlargest(most + 1, counts.values())[-1]
    return Counter({w: n - over for w, n in counts.items() if n > over})


def _summaries(tokenizer: str):
    def run(batches):
        lengths, counts = Lengths(tokenizer, {}), Counter()
        for batch in batches:
            for some in portions([t for t in batch.column(0).to_pylist() if t]):
                for word, n in lengths.pre_tokens(some).items():
                    if len(word) <= LONGEST:
                        counts[word] += n
                if len(counts) > 4 * SUMMARY:
                    counts = thinned(counts, SUMMARY)
        counts = thinned(counts, SUMMARY)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
    return run


def frequent_table(texts: DataFrame, text_col: str, tokenizer: str) -> dict:
    """Lengths of the ``TABLE`` most frequent pre-tokens of all texts, by the sum of the partitions' summaries. The
    driver gets the table and, to find its least count, the number of words by count."""
    summaries = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_summaries(tokenizer), "word string, n long")
    sums = written(summaries.groupBy("word").agg(F.sum("n").alias("n")), "token-sums")
    least, left = 0, TABLE
    for level in sorted(sums.groupBy("n").agg(F.count("*").alias("words")).collect(), key=lambda r: -r.n):
        if level.words > left:
            least = level.n
            break
        left -= level.words
    words = sums.where(F.col("n") > least).select("word").collect() + (sums.where(F.col("n") == least).select("word").take(left) if least else [])
    lengths = Lengths(tokenizer, {})
    return {r.word: lengths[r.word] for r in words}


def count_tokens(docs: DataFrame, text_col: str, tokenizer_file: str, limit: int = 2048) -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``; columns of these names are replaced.

    ``tokenizer_file`` is read on the driver and sent to the executors with the table."""
    tokenizer = open(tokenizer_file, encoding="utf-8").read()
    known = frequent_table(docs, text_col, tokenizer)
    table = docs.sparkSession.sparkContext.broadcast((tokenizer, known, hash((tokenizer, tuple(sorted(known))))))

    @F.pandas_udf("long")
    def n_tokens(texts):
        lengths = _lengths(table)
        return texts.map(lambda t: lengths.count(t) if t else 0).astype("int64")

    text = F.col(text_col)
    return (docs.withColumns({"n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), "n_tokens": n_tokens(text)})
            .withColumn("over_limit", F.col("n_tokens") > limit))
