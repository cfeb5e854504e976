"""Array expressions for logits, labels and vectors.

All are built-in higher-order functions (``transform``, ``aggregate``, ``zip_with``), evaluated in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from termlens.config import TaskMap


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def task_slice(logits, offset: int, n: int) -> Column:
    """V9: the task's logits from the flat vector."""
    return F.slice(col_(logits), offset + 1, n)


def argmax(arr) -> Column:
    """0-based index of the first maximum."""
    a = col_(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def softmax(arr) -> Column:
    """Numerically stable softmax."""
    a = col_(arr)
    mx = F.array_max(a)
    ex = F.transform(a, lambda z: F.exp(z - mx))
    tot = F.aggregate(ex, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(ex, lambda v: v / tot)


def per_task_softmax(logits, tasks: TaskMap) -> Column:
    """``logits_for_tasks``: array of per-task softmax arrays."""
    offs = tasks.offsets()
    return F.array(*[softmax(task_slice(logits, offs[t], n)) for t, n in tasks.tasks])


def per_task_argmax(logits, tasks: TaskMap) -> Column:
    """``pred_for_tasks``: array of per-task argmax."""
    offs = tasks.offsets()
    return F.array(*[argmax(task_slice(logits, offs[t], n)) for t, n in tasks.tasks])


def pick_per_task(nested, idx) -> Column:
    """``nested[t][idx[t]]`` for every task (null-safe)."""
    return F.zip_with(col_(nested), col_(idx), lambda row, i: F.element_at(row, i + 1))


def mean(arr) -> Column:
    a = col_(arr)
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v) / F.size(a)


def _bound(value, fn) -> Column:
    """``fn`` of ``value``, which is evaluated once a row: a column used in a lambda would be put into it and evaluated
    for every element."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def layer_norm(arr, eps: float = 1e-5) -> Column:
    """``(v - mean) / sqrt(var + eps)`` with the biased variance; unit weight, zero bias. Three passes over the array."""
    def normed(a):
        n = F.size(a)

        def about(mu):
            var = F.aggregate(a, F.lit(0.0), lambda acc, v: acc + (v - mu) * (v - mu)) / n
            return _bound(var, lambda var: F.transform(a, lambda v: (v - mu) / F.sqrt(var + F.lit(eps))))

        return _bound(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v) / n, about)

    return _bound(col_(arr), normed)


def with_layer_norm(df, src: str, out: str, eps: float = 1e-5):
    """G6 as a column of ``df``."""
    return df.withColumn(out, layer_norm(src, eps))


def normed_sum(arr, eps: float = 1e-5) -> Column:
    """``s / max(sqrt(|s|), eps)`` element-wise on a summed vector."""
    return F.transform(col_(arr), lambda v: v / F.greatest(F.sqrt(F.abs(v)), F.lit(eps)))


def round_all(arr, digits: int = 9) -> Column:
    return F.transform(col_(arr), lambda v: F.round(v, digits))


def label_index(tasks: TaskMap) -> Column:
    """L1: label vector in task order."""
    return F.array(*[F.col(t).cast("int") for t in tasks.names])


def thermometer(tasks: TaskMap) -> Column:
    """L2: per task, row ``label`` of a lower-triangular ones matrix of width n+1, concatenated."""
    parts = [F.transform(F.sequence(F.lit(0), F.lit(n)), _upto(F.col(t))) for t, n in tasks.tasks]
    return F.concat(*parts)


def _upto(label):
    return lambda i: F.when(i <= label, F.lit(1)).otherwise(F.lit(0))


def reference_ids(ids, cls_id: int, sep_id: int, ref_id: int) -> Column:
    """X11: every id except CLS/SEP replaced by the reference id (shape kept)."""
    return F.transform(col_(ids), lambda x: F.when(x.isin(cls_id, sep_id), x).otherwise(F.lit(ref_id)))


def reference_length(ids, cls_id: int, sep_id: int) -> Column:
    """X11: number of non-special ids."""
    return F.size(F.filter(col_(ids), lambda x: ~x.isin(cls_id, sep_id)))
