"""Configuration: the ordered task map (D3) and typed settings.

Unknown keys raise a clear error naming the key instead of a bare ``TypeError``.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


@dataclass(frozen=True)
class TaskMap:
    """Ordered ``{task: n_labels}``. Order fixes the logit offsets."""

    tasks: tuple[tuple[str, int], ...]

    @classmethod
    def of(cls, mapping: dict[str, int]) -> "TaskMap":
        for name in mapping:
            if "=" in name or "-" in name:
                raise ValueError(f"task name {name!r} must not contain '=' or '-'")
        return cls(tuple((str(k), int(v)) for k, v in mapping.items()))

    @property
    def names(self) -> list[str]:
        return [t for t, _ in self.tasks]

    def n_labels(self, task: str) -> int:
        return dict(self.tasks)[task]

    def offsets(self) -> dict[str, int]:
        out, acc = {}, 0
        for t, n in self.tasks:
            out[t] = acc
            acc += n
        return out

    @property
    def total_labels(self) -> int:
        return sum(n for _, n in self.tasks)

    def table(self, spark: SparkSession) -> DataFrame:
        """``tasks(task, task_index, n_labels, logit_offset)`` - bounded by the config size."""
        offs = self.offsets()
        rows = [(t, i, n, offs[t]) for i, (t, n) in enumerate(self.tasks)]
        schema = T.StructType([
            T.StructField("task", T.StringType(), False),
            T.StructField("task_index", T.IntegerType(), False),
            T.StructField("n_labels", T.IntegerType(), False),
            T.StructField("logit_offset", T.IntegerType(), False),
        ])
        return spark.createDataFrame(rows, schema)

    def class_table(self, spark: SparkSession) -> DataFrame:
        """``task_classes(task, task_index, class, target_name)``; ``target_name = task=class``."""
        rows = [(t, i, c, f"{t}={c}") for i, (t, n) in enumerate(self.tasks) for c in range(n)]
        schema = T.StructType([
            T.StructField("task", T.StringType(), False),
            T.StructField("task_index", T.IntegerType(), False),
            T.StructField("class", T.IntegerType(), False),
            T.StructField("target_name", T.StringType(), False),
        ])
        return spark.createDataFrame(rows, schema)


def _from_dict(cls, data: dict[str, Any]):
    known = {f.name for f in fields(cls)}
    for key in data:
        if key not in known:
            raise ValueError(f"unknown key {key!r} for {cls.__name__}; expected one of {sorted(known)}")
    return cls(**data)


@dataclass
class VectorizerConfig:
    lowercase: bool = True
    ngram_range: tuple[int, int] = (1, 3)
    max_df: float = 0.3
    min_df: int = 2
    sublinear_tf: bool = False
    token_pattern: str = r"[\p{L}\p{N}_]{2,}"

    def __post_init__(self):
        self.ngram_range = tuple(self.ngram_range)


@dataclass
class AggregationConfig:
    aggregators: tuple[str, ...] = ("homogeneity", "avg")
    split: str = "test"
    positive_only: bool = True
    type_filter: str = "!sentence"
    over: tuple[str, ...] = ("task",)
    included_preds: str = "all"
    top_k: int = 50


@dataclass
class DataConfig:
    tasks: dict[str, int] = field(default_factory=lambda: {"quality": 2, "toxic": 2})
    eval_split: str = "eval"
    process_func: str | None = None
    full_data: bool = False
    dev: bool = False


@dataclass
class PipelineConfig:
    data: DataConfig = field(default_factory=DataConfig)
    vectorizer: VectorizerConfig = field(default_factory=VectorizerConfig)
    aggregation: AggregationConfig = field(default_factory=AggregationConfig)

    @property
    def task_map(self) -> TaskMap:
        return TaskMap.of(self.data.tasks)

    @classmethod
    def from_dict(cls, data: dict[str, Any]) -> "PipelineConfig":
        parts = {"data": DataConfig, "vectorizer": VectorizerConfig, "aggregation": AggregationConfig}
        for key in data:
            if key not in parts:
                raise ValueError(f"unknown section {key!r}; expected one of {sorted(parts)}")
        return cls(**{k: _from_dict(parts[k], data.get(k, {})) for k in parts})

    @classmethod
    def from_json(cls, path: str) -> "PipelineConfig":
        with open(path, encoding="utf-8") as fh:
            return cls.from_dict(json.load(fh))


DEFAULT_TASKS = TaskMap.of({"quality": 2, "toxic": 2})
