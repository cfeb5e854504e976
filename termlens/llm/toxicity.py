"""Operator 3: toxicity by a linear-chain conditional random field over words.

The labels mark documents. Token labels are distilled from a bounded sample of labelled training rows: in a
toxic document the words with the strongest evidence (log-likelihood ratio between toxic and clean documents,
at least a quarter of the document's best) are labelled 1, everything else 0. A two-label chain with one
weight per vocabulary word, one for all other words, and transition weights is fitted to these by L-BFGS;
every step is one Spark job that sums the gradient over partitions. Forward-backward marginals score every
word of every whole document; a logistic fit over (log-odds of the largest marginal, log of one plus their sum)
turns them into a document score, and words with a marginal of 0.5 or more are the offending spans.

Bounds (parameters): the fit uses at most ``SAMPLE`` labelled rows, chosen by a hash of the id; the vocabulary
has at most ``VOCABULARY`` words that occur in at least ``LEAST`` sample documents. Scoring covers all rows and
whole texts.

Defined cases: null text scores as empty text (no words); rows without a label or id train nothing; several
labels of one id count as toxic if their mean is at least 0.5; without training rows, or with one class only,
every score is the smoothed share of toxic rows (0.5 without any); repeated rows are scored each.
"""


import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlens.llm.common import portions, tree_sum, written

SAMPLE = 20_000
VOCABULARY = 1 << 17
LEAST = 3
SURE = 8.0  # least log-likelihood ratio of a word that may be labelled toxic
STEPS = 12
PENALTY = 0.02
CACHE = 1 << 18
_WORD = re.compile(r"[^\W\d_]+")


class Vocabulary(dict):
    """Word as written -> number (0: any other word); spellings in other case are looked up once."""

    def __init__(self, words: dict):
        super().__init__(words)
        self.words, self.room = words, len(words) + CACHE

    def __missing__(self, word: str) -> int:
        n = self.words.get(word.lower(), 0)
        if len(self) < self.room and len(word) <= 64:
            self[word] = n
        return n

    def numbers(self, text: str | None) -> np.ndarray:
        found = _WORD.findall(text or "")
        return np.fromiter(map(self.__getitem__, found), dtype=np.int32, count=len(found))


def _chain(p, q, r, s, width: int = 128) -> np.ndarray:
    """x[t] = (p[t] + q[t] x[t-1]) / (r[t] + s[t] x[t-1]); q = s = 0 where a text begins.

    Rows of ``width`` steps are composed side by side into one fraction each, the fractions are chained, and
    the steps are taken again from the right starting values."""
    n = len(p)
    if not n:
        return np.zeros(0)
    rows = -(-n // width)
    pad = rows * width - n
    shaped = [np.append(a, np.full(pad, f)).reshape(rows, width).T.copy() for a, f in ((p, 1.0), (q, 0.0), (r, 1.0), (s, 0.0))]
    p, q, r, s = shaped
    a, b, c, d = p[0].copy(), q[0].copy(), r[0].copy(), s[0].copy()
    for t in range(1, width):
        a, b, c, d = p[t] * c + q[t] * a, p[t] * d + q[t] * b, r[t] * c + s[t] * a, r[t] * d + s[t] * b
        size = np.maximum(np.maximum(a, b), np.maximum(c, d))
        a, b, c, d = a / size, b / size, c / size, d / size
    start = np.empty(rows)
    x = 0.0
    for k in range(rows):
        start[k] = x
        x = (a[k] + b[k] * x) / (c[k] + d[k] * x)
    out = np.empty((width, rows))
    x = start
    for t in range(width):
        x = (p[t] + q[t] * x) / (r[t] + s[t] * x)
        out[t] = x
    return out.T.reshape(-1)[:n]


class Crf:
    """Weights: one per vocabulary number (log-odds of label 1), then transitions 01, 10, 11 and the start."""

    def __init__(self, size: int):
        self.size = size
        self.theta = np.zeros(size + 4)
        self.theta[:size] = -4.0
        self.theta[size] = -1.0

    def messages(self, numbers: np.ndarray, lengths: np.ndarray):
        """(potential, first, last, forward odds, backward odds) of concatenated texts."""
        lengths = lengths[lengths > 0]
        ends = np.cumsum(lengths)
        first, last = np.zeros(len(numbers), dtype=bool), np.zeros(len(numbers), dtype=bool)
        first[ends - lengths], last[ends - 1] = True, True
        e = np.exp(np.clip(self.theta[:self.size], -25, 25))[numbers]
        t01, t10, t11, s0 = np.exp(np.clip(self.theta[self.size:], -25, 25))
        forward = _chain(np.where(first, e * s0, e * t01), np.where(first, 0, e * t11), np.ones(len(e)), np.where(first, 0, t10))
        nxt = np.append(e[1:], 1.0)
        backward = _chain(np.where(last, 1, t10)[::-1], np.where(last, 0, t11 * nxt)[::-1], np.ones(len(e)), np.where(last, 0, t01 * nxt)[::-1])[::-1]
        return e, first, last, forward, backward

    def marginals(self, numbers: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        if not len(numbers):
            return np.zeros(0)
        _, _, _, forward, backward = self.messages(numbers, lengths)
        odds = forward * backward
        return odds / (1 + odds)

    def gradient(self, numbers: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> np.ndarray:
        """[log-likelihood, its gradient] of labelled texts."""
        out = np.zeros(1 + len(self.theta))
        if not len(numbers):
            return out
        e, first, last, forward, backward = self.messages(numbers, lengths)
        t01, t10, t11, s0 = np.exp(np.clip(self.theta[self.size:], -25, 25))
        before, y0 = np.append(0.0, forward[:-1]), np.append(0, y[:-1])
        z = np.where(first, 1 + e * s0, (1 + t10 * before + e * (t01 + t11 * before)) / (1 + before))
        logs = np.where(y == 1, np.log(e), 0.0)
        moves = self.theta[self.size:]
        step = np.where(first, y * moves[3], np.where(y0 == 0, y * moves[0], np.where(y == 0, moves[1], moves[2])))
        out[0] = (logs + step - np.log(z)).sum()
        odds = forward * backward
        p = odds / (1 + odds)
        out[1:1 + self.size] = np.bincount(numbers, weights=y - p, minlength=self.size)
        a, b, inner = before[~first], (e * backward)[~first], ~first
        total = 1 + t01 * b + a * t10 + a * t11 * b
        y1, y0 = y[inner], y0[inner]
        out[-4:] = [((y0 == 0) & (y1 == 1)).sum() - (t01 * b / total).sum(), ((y0 == 1) & (y1 == 0)).sum() - (a * t10 / total).sum(),
                    ((y0 == 1) & (y1 == 1)).sum() - (a * t11 * b / total).sum(), (y[first] - p[first]).sum()]
        return out


def document_features(marginals: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(log-odds of the largest marginal, log(1 + sum)) per document; (-12, 0) for one without words."""
    out = np.zeros((len(lengths), 2))
    out[:, 0] = -12.0
    full = np.flatnonzero(lengths > 0)
    if len(full):
        at = np.cumsum(lengths[full]) - lengths[full]
        top = np.clip(np.maximum.reduceat(marginals, at), 1e-9, 1 - 1e-9)
        out[full, 0] = np.clip(np.log(top / (1 - top)), -12, 12)
        out[full, 1] = np.log1p(np.add.reduceat(marginals, at))
    return out


class Model:
    """Vocabulary, chain and document weights."""

    def __init__(self, words: dict, rate: float):
        self.words, self.rate, self.crf, self.weights = words, rate, None, None

    def annotate(self, texts, vocabulary: Vocabulary):
        numbers = [vocabulary.numbers(t) for t in texts]
        lengths = np.array([len(x) for x in numbers], dtype=np.int64)
        return (self.crf.marginals(np.concatenate(numbers), lengths) if len(numbers) else np.zeros(0)), lengths

    def probability(self, marginals, lengths) -> np.ndarray:
        x = np.column_stack([np.ones(len(lengths)), document_features(marginals, lengths)])
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Newton's method for a logistic fit with three weights; slopes are kept at 0 or more."""
    def solve(x):
        w = np.zeros(x.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            ridge = penalty * np.eye(x.shape[1])
            ridge[0, 0] = 1e-6
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
            w += np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-8:
                break
        return w

    w = solve(x)
    if w[2] < 0:  # more offending words never make a text less toxic
        w = np.append(solve(x[:, :2]), 0.0)
    return w


def _ratio(a, b, toxic, clean):
    """Signed log-likelihood ratio of document counts; positive if the word is commoner in toxic documents."""
    def part(x, expected):
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-12) / expected), 0.0)

    share = (a + b) / (toxic + clean)
    g = 2 * (part(a, share * toxic) + part(b, share * clean) + part(toxic - a, (1 - share) * toxic + 1e-12) + part(clean - b, (1 - share) * clean + 1e-12))
    return np.where(a * clean > b * toxic, g, -g)


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, train) -> Model:
    """Fit on at most ``SAMPLE`` of the rows of ``docs`` where ``train`` holds and ``labels`` has a label."""
    spark = docs.sparkSession
    marks = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("t_id"))
             .agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("int").alias("label")))
    ids = docs.where(train).select(F.col(id_col).alias("t_id")).distinct()
    chosen = marks.join(ids, "t_id", "left_semi").orderBy(F.xxhash64("t_id"), "t_id").limit(SAMPLE)
    sample = written(docs.where(train).select(F.col(id_col).alias("t_id"), F.col(text_col).alias("text"))
                     .join(F.broadcast(chosen), "t_id").repartition(4 * spark.sparkContext.defaultParallelism, F.xxhash64("t_id")), "toxic-sample")  # SAMPLE ids at most
    share = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = share.get(1, 0), share.get(0, 0)
    model = Model({}, (toxic + 0.5) / (toxic + clean + 1))
    if not toxic or not clean:
        return model

    def document_words(frames):
        for rows in frames:
            found = [(w, y) for t, y in zip(rows.text, rows.label) for w in {x.lower() for x in _WORD.findall(t or "")}]
            yield pd.DataFrame(found, columns=["word", "label"]).groupby("word").label.agg(["size", "sum"]).reset_index()

    counts = (sample.select("text", "label").mapInPandas(document_words, "word string, size long, sum long").groupBy("word")
              .agg(F.sum("size").alias("n"), F.sum("sum").alias("a")).where(F.col("n") >= LEAST)
              .orderBy(F.desc("n"), "word").limit(VOCABULARY - 1).toPandas())
    model.words = {w: i + 1 for i, w in enumerate(counts["word"])}
    a = counts["a"].to_numpy(dtype=float)
    ratio = np.append(0.0, _ratio(a, counts["n"].to_numpy(dtype=float) - a, toxic, clean)) if len(counts) else np.zeros(1)
    held = spark.sparkContext.broadcast((model.words, ratio))

    def sequences(frames):
        words, evidence = held.value
        vocabulary = Vocabulary(words)
        for rows in frames:
            out = []
            for text, label in zip(rows.text, rows.label):
                numbers = vocabulary.numbers(text)
                g = evidence[numbers]
                y = (g >= max(SURE, 0.25 * g.max())) if label and len(numbers) else np.zeros(len(numbers), dtype=bool)
                out.append((numbers.tobytes(), y.astype(np.int8).tobytes(), int(label)))
            yield pd.DataFrame(out, columns=["numbers", "y", "label"])

    tagged = written(sample.select("text", "label").mapInPandas(sequences, "numbers binary, y binary, label int"), "toxic-tags")
    crf = Crf(len(ratio))

    def batches(rows):
        """Rows of a frame as (numbers, lengths, labels), a few hundred thousand words at a time."""
        for lo in range(0, len(rows), 400):
            part = rows.iloc[lo:lo + 400]
            numbers = [np.frombuffer(x, np.int32) for x in part.numbers]
            lengths = np.array([len(x) for x in numbers], dtype=np.int64)
            yield np.concatenate(numbers), lengths, np.concatenate([np.frombuffer(x, np.int8) for x in part.y]).astype(np.int64)

    def loss(theta):
        """(minus penalised log-likelihood, gradient), summed over partitions by one job."""
        now = Crf(crf.size)
        now.theta = theta
        sent = spark.sparkContext.broadcast(now)

        def summed(frames):
            total = None
            for rows in frames:
                for part in batches(rows):
                    g = sent.value.gradient(*part)
                    total = g if total is None else total + g
            if total is not None:
                yield pd.DataFrame({"v": [total.tobytes()]})

        total = tree_sum(tagged.mapInPandas(summed, "v binary"))
        sent.unpersist()
        return -total[0] + 0.5 * PENALTY * theta @ theta, -total[1:] + PENALTY * theta

    def occurrences(frames):
        total = np.zeros(2 * crf.size)
        for rows in frames:
            for numbers, _, y in batches(rows):
                total[:crf.size] += np.bincount(numbers, weights=y, minlength=crf.size)
                total[crf.size:] += np.bincount(numbers, weights=1 - y, minlength=crf.size)
        yield pd.DataFrame({"v": [total.tobytes()]})

    # the optimum without transitions is the log-odds of each word's labels: a start close to the goal
    ones, zeros = tree_sum(tagged.mapInPandas(occurrences, "v binary")).reshape(2, -1)
    crf.theta[:crf.size] = np.log((ones + 0.02) / (zeros + 1.0))
    crf.theta[crf.size:] = 0.0
    crf.theta = _lbfgs(loss, crf.theta, STEPS)
    model.crf = crf
    fitted = spark.sparkContext.broadcast(crf)

    def features(frames):
        for rows in frames:
            f = [document_features(fitted.value.marginals(numbers, lengths), lengths) for numbers, lengths, _ in batches(rows)]
            if f:
                f = np.concatenate(f)
                yield pd.DataFrame({"top": f[:, 0], "all": f[:, 1], "label": rows.label})

    got = tagged.mapInPandas(features, "top double, all double, label int").toPandas()  # at most SAMPLE rows
    model.weights = _logistic(np.column_stack([np.ones(len(got)), got["top"], got["all"]]), got["label"].to_numpy(dtype=float))
    return model


def _lbfgs(loss, x: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """Minimise by L-BFGS with step halving."""
    value, slope = loss(x)
    history: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, kept = slope.copy(), []
        for s, g in reversed(history):
            c = s @ d / (s @ g)
            d -= c * g
            kept.append(c)
        d *= history[-1][0] @ history[-1][1] / (history[-1][1] @ history[-1][1]) if history else 1 / max(1.0, np.abs(slope).max())
        for (s, g), c in zip(history, reversed(kept)):
            d += s * (c - g @ d / (s @ g))
        size = 1.0
        for _ in range(6):
            new, new_slope = loss(x - size * d)
            if new < value:
                break
            size /= 4
        else:
            break
        s, g = -size * d, new_slope - slope
        if s @ g > 1e-12:
            history = [*history, (s, g)][-memory:]
        done = value - new < 1e-5 * abs(value)
        x, value, slope = x + s, new, new_slope
        if done:
            break
    return x


def _spans(texts, marginals: np.ndarray, lengths: np.ndarray) -> list[list]:
    """Per text, where its words with a marginal of 0.5 or more are."""
    spans: list[list] = [[] for _ in texts]
    ends = np.cumsum(lengths)
    hits = np.flatnonzero(marginals >= 0.5)
    owner = np.searchsorted(ends, hits, side="right")
    for doc in np.unique(owner):
        words = list(_WORD.finditer(texts[doc]))
        for at in hits[owner == doc]:
            m = words[at - (ends[doc] - lengths[doc])]
            spans[doc].append({"start": m.start(), "end": m.end(), "marginal": float(marginals[at])})
    return spans


def scored(docs: DataFrame, model: Model, text_col: str, threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``score``, ``predicted`` (1 if score >= threshold) and ``spans``: (start, end, marginal) in
    characters of the text, end exclusive, of the words with a marginal of 0.5 or more."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = "struct<score:double,spans:array<struct<start:int,end:int,marginal:double>>>"

    @F.pandas_udf(kind)
    def tag(batches_of: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        fitted = held.value
        vocabulary = Vocabulary(fitted.words)
        for texts in batches_of:
            if fitted.weights is None:
                yield pd.DataFrame({"score": [fitted.rate] * len(texts), "spans": [[] for _ in range(len(texts))]})
                continue
            scores, spans = [], []
            for part in portions(texts.tolist(), 1 << 20):
                marginals, lengths = fitted.annotate(part, vocabulary)
                scores.append(fitted.probability(marginals, lengths))
                spans += _spans(part, marginals, lengths)
            yield pd.DataFrame({"score": np.concatenate(scores) if scores else [], "spans": spans})

    return (docs.withColumn("toxic_tag", tag(F.col(text_col))).withColumn("score", F.col("toxic_tag.score"))
            .withColumn("spans", F.col("toxic_tag.spans")).drop("toxic_tag")
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
