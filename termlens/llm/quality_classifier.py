"""Operator 4: quality classifier over document statistics.

Statistics of a text (lengths, letter classes, repetition, lines, compressibility) are standardised, mapped by
random Fourier features that approximate a Gaussian kernel, and fitted by ridge regression: every partition
sums its part of the normal equations, sums meet in a tree, and the driver solves one ``FEATURES`` x
``FEATURES`` system. Isotonic regression over the binned fitted scores turns them into probabilities.

All labelled training rows are used. Per row nothing but the text is an input of the score.

Defined cases: null text scores as empty text; rows without a label, or with a null id, train nothing;
several labels of one id count as their mean; without any training row every score is 0.5; without both
classes it is the mean label; repeated rows are scored each.
"""

from __future__ import annotations

import operator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlens.llm.common import tree_sum, written

FEATURES = 320  # random features
WIDTH = 0.35  # kernel width times the root of the number of statistics gives the Gaussian's standard deviation
RIDGE = 1e-4  # times the number of rows
BINS = 4000  # bins of fitted scores from -1 to 2 for the calibration
_KINDS = np.zeros(256, dtype=np.int64)
for _kind, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\v\f", b"\n",
                                b"|", b"!", b".,;:?", b"*%$&#@^~+=", b"'\"()[]{}<>", b"-_/\\`"), start=1):
    _KINDS[list(_chars)] = _kind
_KINDS[128:] = 12


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text."""
    data = (text or "").encode()
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    kinds = np.bincount(_KINDS[np.frombuffer(data, np.uint8)], minlength=13).astype(float)
    n, size = max(1, len(words)), max(1, len(data))
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=len(words)) if words else np.zeros(1)
    letters = max(1.0, kinds[1] + kinds[2] + kinds[12])
    distinct, lower = len(set(words)), len({w.lower() for w in words})
    packed = len(pa.compress(data, codec="zstd", asbytes=True)) if data else 0
    title = sum(map(bytes.istitle, words))
    return [np.log1p(len(data)), np.log1p(len(words)), np.log1p(len(lines)), np.log1p(len(words) / max(1, len(lines))),
            kinds[1] / letters, kinds[2] / letters, kinds[3] / size, kinds[4] / size, kinds[5] / n,
            *np.sqrt(kinds[6:12] / n), kinds[12] / size, lengths.mean(), np.log1p(lengths.std()), np.log1p(lengths.max()),
            distinct / n, lower / n, np.log1p(distinct) / np.log1p(n), sum(map(operator.eq, words, words[1:])) / n,
            sum(map(operator.eq, words, words[2:])) / n, title / n, len(set(lines)) / max(1, len(lines)), packed / (size + 32),
            float((lengths <= 3).mean()), float((lengths >= 15).mean())]


def _table(texts) -> np.ndarray:
    return np.array([statistics(t) for t in texts], dtype=np.float64).reshape(len(texts), -1)


class Model:
    """Standardisation, random features, ridge weights and the calibration curve; a few hundred kB."""

    def __init__(self, mean, scale, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.directions = rng.normal(size=(len(mean), FEATURES)) / (WIDTH * np.sqrt(len(mean)))
        self.phases = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.at, self.level = np.array([0.0]), np.array([0.5])

    def expand(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.directions + self.phases), np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.expand(stats) @ self.weights

    def probability(self, texts) -> np.ndarray:
        return np.interp(self.raw(_table(texts)), self.at, self.level) if len(texts) else np.zeros(0)


def _sums(expand):
    def run(frames):
        total = None
        for rows in frames:
            if len(rows):
                x = expand(np.array(rows.stats.tolist()))
                x1 = np.column_stack([x, rows.label.to_numpy(dtype=float)])
                part = x1.T @ x1
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"v": [total.tobytes()]})
    return run


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing fit of ``values`` with ``weights``."""
    level, weight, size = [], [], []
    for v, w in zip(values, weights):
        level.append(v)
        weight.append(w)
        size.append(1)
        while len(level) > 1 and level[-2] >= level[-1]:
            w2 = weight[-2] + weight[-1]
            level[-2] = (level[-2] * weight[-2] + level[-1] * weight[-1]) / w2
            weight[-2], size[-2] = w2, size[-2] + size[-1]
            level.pop(), weight.pop(), size.pop()
    return np.repeat(level, size)


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, train, seed: int = 7) -> Model:
    """Fit on the rows of ``docs`` where ``train`` (a boolean column of ``docs``) holds and ``labels`` has a label."""
    @F.pandas_udf("array<double>")
    def stats(texts):
        return pd.Series(list(_table(texts.tolist())), index=texts.index)

    marks = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
             .groupBy(F.col(id_col).alias("q_id")).agg(F.avg(F.col(label_col).cast("double")).alias("label")))
    rows = docs.where(train).select(F.col(id_col).alias("q_id"), stats(F.col(text_col)).alias("stats"))
    rows = written(rows.join(marks, "q_id").select("stats", "label"), "quality-rows")
    width = len(statistics(""))
    moments = tree_sum(rows.mapInPandas(_sums(lambda x: np.hstack([x, np.ones((len(x), 1))])), "v binary"))
    if moments is None:
        return Model(np.zeros(width), np.ones(width), seed)
    moments = moments.reshape(width + 2, width + 2)
    n = moments[width, width]
    mean = moments[width, :width] / n
    scale = np.sqrt(np.maximum(np.diag(moments)[:width] / n - mean**2, 1e-8))
    model = Model(mean, scale, seed)
    normal = tree_sum(rows.mapInPandas(_sums(model.expand), "v binary")).reshape(FEATURES + 2, FEATURES + 2)
    gram, moment = normal[:-1, :-1], normal[:-1, -1]
    penalty = np.full(FEATURES + 1, RIDGE * n)
    penalty[-1] = 1e-9
    model.weights = np.linalg.solve(gram + np.diag(penalty), moment)

    def binned(frames):
        for part in frames:
            if len(part):
                raw = model.raw(np.array(part.stats.tolist()))
                at = np.clip(np.floor((raw + 1) / 3 * BINS), 0, BINS - 1).astype(np.int64)
                yield pd.DataFrame({"bin": at, "label": part.label.astype(float)}).groupby("bin").label.agg(["size", "sum"]).reset_index()

    bins = (rows.mapInPandas(binned, "bin long, size long, sum double").groupBy("bin")
            .agg(F.sum("size").alias("size"), F.sum("sum").alias("sum")).orderBy("bin").toPandas())  # at most BINS rows
    rate = moment[-1] / n
    level = isotonic((bins["sum"] / bins["size"]).to_numpy(), bins["size"].to_numpy(dtype=float))
    group = pd.DataFrame({"level": level, "size": bins["size"], "at": (bins["bin"] + 0.5) / BINS * 3 - 1}).groupby("level")
    sizes = group["size"].sum().to_numpy(dtype=float)
    smooth = (group["size"].sum().to_numpy() * group["level"].first().to_numpy() + rate) / (sizes + 1)
    flat = pd.DataFrame({"lo": group["at"].min(), "hi": group["at"].max()}).reset_index(drop=True)
    smooth = isotonic(smooth, sizes)
    model.at = np.column_stack([flat.lo, flat.hi + 1e-9]).reshape(-1)
    model.level = np.clip(np.repeat(smooth, 2), 0, 1)
    return model


def scored(docs: DataFrame, model: Model, text_col: str, threshold: float = 0.7) -> DataFrame:
    """``docs`` with ``score`` (probability of label 1) and ``predicted`` (1 if score >= threshold)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(texts):
        return pd.Series(held.value.probability(texts.tolist()), index=texts.index)

    return docs.withColumn("score", probability(F.col(text_col))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
