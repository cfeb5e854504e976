"""Text and n-gram column expressions.

All helpers return ``Column`` objects built from built-in functions, so they stay inside
whole-stage codegen; none of them needs a Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from termlens.functions.stopwords import LANGUAGES_WITH_STOPWORDS, PUNCTUATION, SPECIAL_TOKENS, stopwords_for

# Word characters of any script: letters, digits, underscore (what a Unicode ``\w`` means).
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text, pattern: str = WORD_PATTERN, lowercase: bool = True) -> Column:
    """T1+T2: lower-cased word tokens of at least two word characters, in order."""
    t = F.lower(col_(text)) if lowercase else col_(text)
    return F.regexp_extract_all(t, F.lit(pattern), 0)


def drop_stopwords(words_col, lang_col, german_variant: str = "modified") -> Column:
    """Remove the language's stop words from a word array (order kept; other languages untouched).

    ``isin`` over literals is rewritten by the optimizer into a hash-set lookup.
    """
    w = col_(words_col)
    expr = None
    for lang in LANGUAGES_WITH_STOPWORDS:
        stop = list(stopwords_for(lang, german_variant))
        filtered = F.filter(w, _not_in(stop))
        cond = col_(lang_col) == F.lit(lang)
        expr = F.when(cond, filtered) if expr is None else expr.when(cond, filtered)
    return expr.otherwise(w)


def _not_in(values):
    # PySpark infers a lambda's arity from its signature, so closures are built by factories.
    return lambda x: ~x.isin(values)


def _gram_at(w, n):
    return lambda i: F.array_join(F.slice(w, i, n), " ")


def ngrams(words_col, n_min: int = 1, n_max: int = 3) -> Column:
    """All word n-grams, n_min..n_max, joined with a single space."""
    w = col_(words_col)
    parts = []
    for n in range(n_min, n_max + 1):
        grams = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), _gram_at(w, n))
        parts.append(F.when(F.size(w) >= n, grams).otherwise(empty_strings()))
    return F.flatten(F.array(*parts))


def ngram_type(term) -> Column:
    """T4: ``<words>gram``."""
    return F.concat(F.size(F.split(col_(term), " ")).cast("string"), F.lit("gram"))


def is_special(term) -> Column:
    return col_(term).isin(SPECIAL_TOKENS)


def is_punctuation(term) -> Column:
    return col_(term).isin(PUNCTUATION)


def keep_word(term, lang_col=None, german_variant: str = "modified") -> Column:
    """F8+F9 ``filter_words``: not special, not punctuation, not a stop word of the language."""
    t = col_(term)
    keep = ~is_special(t) & ~is_punctuation(t)
    if lang_col is not None:
        for lang in LANGUAGES_WITH_STOPWORDS:
            stop = list(stopwords_for(lang, german_variant))
            keep = keep & ~((col_(lang_col) == F.lit(lang)) & F.lower(t).isin(stop))
    return keep


# ---- fixed values: padded punctuation, and the runs of blanks that are squeezed ----
CLEAN_PUNCT = r"([.,!?()])"
CLEAN_BLANKS = r"\s{2,}"
# ------------------------------------------------------------------------------------


def clean_text(text) -> Column:
    """Pad ``. , ! ? ( )`` with spaces, then squeeze runs of two or more blanks; no trimming."""
    padded = F.regexp_replace(col_(text), CLEAN_PUNCT, " $1 ")
    return F.regexp_replace(padded, CLEAN_BLANKS, " ")


def strip_marker(token, marker: str = "Ġ") -> Column:
    """Drop the byte-level BPE space marker."""
    return F.replace(col_(token), F.lit(marker), F.lit(""))


def line_split(text) -> Column:
    """First stage of T8: split on new lines and ``<br/>`` variants."""
    return F.split(col_(text), r"\n|<\s*?br\s*?/\s*?>")


SENTENCE_MARK = "\u0001"


def sentence_split(text) -> Column:
    """T8 (rule based): lines, then sentence ends ``[.!?]`` followed by white space; trimmed, no empties."""
    lines = line_split(text)
    marked = F.transform(lines, lambda ln: F.regexp_replace(ln, r"([.!?])\s+", "$1" + SENTENCE_MARK))
    pieces = F.flatten(F.transform(marked, lambda ln: F.split(ln, SENTENCE_MARK)))
    return F.filter(F.transform(pieces, lambda s: F.trim(s)), lambda s: F.length(s) > 0)


def chunk_starts(n_tokens, size: int, overlap: int = 0) -> Column:
    """1-based start positions of windows of ``size`` tokens advancing by ``size - overlap``."""
    n = col_(n_tokens)
    step = size - overlap
    last = F.greatest(n - F.lit(overlap), F.lit(1))
    return F.when(n <= size, F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), last - 1, F.lit(step)))


def regex_escape(term) -> Column:
    """Escape every regex metacharacter of a literal term."""
    return F.regexp_replace(col_(term), r"([\\.\[\]{}()*+?^$|])", r"\\$1")


PHRASE_GAP = r"\b(?:[^\n]{0,12}|\s)\b"


def phrase_pattern(term) -> Column:
    """Word-bounded phrase; up to 12 characters allowed between consecutive words."""
    return F.concat(F.lit(r"\b"), F.replace(regex_escape(term), F.lit(" "), F.lit(PHRASE_GAP)), F.lit(r"\b"))


def truncate_tokens(tokens, n: int) -> Column:
    """The first ``n`` tokens."""
    return F.slice(col_(tokens), 1, n)


def mask_positions(tokens, positions, mask: str = "[MASK]") -> Column:
    """Replace the tokens at the given 0-based positions with the mask token (shape kept)."""
    pos = col_(positions)
    return F.transform(col_(tokens), lambda x, i: F.when(F.array_contains(pos, i), F.lit(mask)).otherwise(x))


def target_names_filter(names, classes: str = "012") -> Column:
    """target names ``task=<class>`` of the listed classes."""
    return col_(names).rlike(f"=[{classes}]")


def unigram_only(term) -> Column:
    """single-word terms."""
    return ~F.instr(col_(term), " ").cast("boolean")
