"""Operator 13: periodic runs of words, by a sparse diagonal DP, and texts with the repeats taken out.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are identical), at least
``max(min_length, 2 * q)`` words long, that no neighbouring word extends with that period.

On the diagonal of lag ``q`` the match length at word ``i`` is one more than at word ``i - 1`` where word ``i`` equals word
``i - q``, else 0. Only lags at which a word has an earlier occurrence are ever active. A diagonal that emits a run
matches over at least ``ceil(min_length / 2)`` words, so an occurrence counts when that many words from it on agree; and it
opens its diagonal only where the words ahead of the two differ, for otherwise the diagonal is active already. So each
diagonal is opened once, and a text that repeats one line a thousand times opens a thousand, not half a million. An
open diagonal is advanced until its words differ, by doubling strides over prefix hashes. Where it ends with
``max(min_length - q, q)`` matches or more it emits its stretch; one that lies in the stretch of a shorter lag has
that lag's period, which is its smallest, and is dropped. Emitted runs are compared word by word; if a hash lied,
the portion is done again with other hashes, so results are exact.

The work is a narrow ``mapInArrow`` over documents: no shuffle, portions of about 2 MB of text at a time; a document is
one unit of work and never split. Opened pairs are made in blocks of 2 million, so memory does not grow with them.

Defined cases: a null, empty or blank text has no runs and collapses to the empty text; rows repeat if they do in the
input, each with its own result; other columns are not carried, so none can clash; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlens.llm.common import mixed, portions

PAIRS = 2 << 20  # opened diagonals looked at together
_ODD = np.uint64(0xD6E8FEB86659FD93)
_STEP = np.uint64(0x9E3779B97F4A7C15)

SCHEMA = "id {}, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _opened(ids: np.ndarray, doc: np.ndarray, letters: np.ndarray, width: int):
    """Blocks of (earlier, later) positions at which ``width`` words agree, the words ahead of them not."""
    m = len(ids) - width + 1
    if m < 2:
        return
    key = mixed(doc[:m].astype(np.uint64)) * _ODD
    for k in range(width):
        key = key * _STEP + letters[k:k + m]
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = key[1:] == key[:-1]
    pos = order[np.append(False, same) | np.append(same, False)]
    if not len(pos):
        return
    key = key[np.append(False, same) | np.append(same, False)]
    group = np.cumsum(np.append(True, key[1:] != key[:-1]))
    ahead = ids[pos - 1]  # position 0 holds a mark, which occurs once
    order = np.lexsort((pos, ahead, group))
    pos, group, ahead = pos[order], group[order], ahead[order]
    at = np.arange(len(pos))
    new_group = np.append(True, group[1:] != group[:-1])
    new_class = new_group | np.append(True, ahead[1:] != ahead[:-1])
    first = np.maximum.accumulate(np.where(new_group, at, 0))
    own = np.maximum.accumulate(np.where(new_class, at, 0))
    partners = own - first  # members of the group with another word ahead, each pair once
    total = np.cumsum(partners)
    lo = 0
    while lo < len(pos):
        done = total[lo - 1] if lo else 0
        hi = max(int(np.searchsorted(total, done + PAIRS, side="right")), lo + 1)
        n = partners[lo:hi]
        if n.sum():
            one = np.repeat(at[lo:hi], n)
            inside = np.arange(len(one)) - np.repeat(np.cumsum(n) - n, n)
            a, b = pos[one], pos[first[one] + inside]
            yield np.minimum(a, b), np.maximum(a, b)
        lo = hi


def _stretches(ids: np.ndarray, doc: np.ndarray, min_length: int, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all diagonals that end with sufficient length, by the hashes of ``salt``."""
    letters = mixed(ids.astype(np.uint64) * _ODD + np.uint64(salt * 2 + 1))
    powers = np.full(len(ids) + 1, _STEP, dtype=np.uint64)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    sums = np.zeros(len(ids) + 1, dtype=np.uint64)
    np.cumsum(letters * powers[:-1], out=sums[1:])

    def agree(j, i, n):
        return (sums[j + n] - sums[j]) * powers[i - j] == sums[i + n] - sums[i]

    found = []
    for j, i in _opened(ids, doc, letters, -(-min_length // 2)):
        q = i - j
        need = np.maximum(min_length - q, q)
        fits = i + need <= len(ids)
        j, i, q, need = j[fits], i[fits], q[fits], need[fits]
        long_enough = agree(j, i, need)
        j, i, q, length = j[long_enough], i[long_enough], q[long_enough], need[long_enough]
        if not len(j):
            continue
        stride = np.int64(1) << np.int64(int(len(ids)).bit_length())
        while stride:  # the longest agreement: binary digits of it from the largest down
            ok = i + length + stride <= len(ids)
            ok[ok] = agree(j[ok], i[ok], length[ok] + stride)
            length = length + ok * stride
            stride >>= 1
        found.append((j, i + length, q))
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*found))


def _smallest(start: np.ndarray, end: np.ndarray, period: np.ndarray):
    """Without the stretches that lie in one of a smaller period."""
    order = np.argsort(period, kind="stable")
    start, end, period = start[order], end[order], period[order]
    keep = np.zeros(len(start), dtype=bool)
    bounds = np.append(np.flatnonzero(np.append(True, period[1:] != period[:-1])), len(period))
    ks, ke = np.zeros(0, np.int64), np.zeros(0, np.int64)  # kept so far, by start; furthest end up to each
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        reach = np.maximum.accumulate(ke) if len(ke) else ke
        at = np.searchsorted(ks, start[lo:hi], side="right") - 1
        inside = (at >= 0) & (reach[at] >= end[lo:hi]) if len(ks) else np.zeros(hi - lo, dtype=bool)
        keep[lo:hi] = ~inside
        if not inside.all():
            ks, ke = np.concatenate([ks, start[lo:hi][~inside]]), np.concatenate([ke, end[lo:hi][~inside]])
            order = np.argsort(ks, kind="stable")
            ks, ke = ks[order], ke[order]
    return start[keep], end[keep], period[keep]


def find_runs(ids: np.ndarray, doc: np.ndarray, min_length: int = 12):
    """(start, length, period), by start and period, of the runs in a stream of word ids; ``doc`` numbers the text a
    word is of. Every text must have an id of its own ahead of its first word that occurs nowhere else."""
    for salt in count():
        start, end, period = _smallest(*_stretches(ids, doc, min_length, salt))
        if all(e <= len(ids) and (ids[s:e - q] == ids[s + q:e]).all() and (e == len(ids) or ids[e] != ids[e - q])
               for s, e, q in zip(start.tolist(), end.tolist(), period.tolist())):
            break
    order = np.lexsort((period, start))
    return start[order], (end - start)[order], period[order]


def _portion(texts: list[bytes | None], min_length: int):
    """Per text: its runs as (start, length, period) and its words without the repeats."""
    words = [(t or b"").split() for t in texts]  # bytes.split: at ASCII white space
    codes: dict[bytes, int] = {}
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    offsets = np.cumsum(sizes + 1) - sizes  # position of each text's first word, a mark ahead of it
    ids = np.empty(int(sizes.sum()) + len(words), dtype=np.int64)
    for k, w in enumerate(words):
        ids[offsets[k] - 1] = -1 - k
        ids[offsets[k]:offsets[k] + len(w)] = [codes.setdefault(x, len(codes)) for x in w]
    doc = np.repeat(np.arange(len(words)), sizes + 1)
    start, length, period = find_runs(ids, doc, min_length)
    drops = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(drops, start + period, 1)
    np.add.at(drops, start + length, -1)
    dropped = np.cumsum(drops)[:-1] > 0
    bounds = np.searchsorted(doc[start], np.arange(len(words) + 1)) if len(start) else np.zeros(len(words) + 1, dtype=int)
    for k, w in enumerate(words):
        lo, hi = bounds[k], bounds[k + 1]
        if lo < hi:
            gone = dropped[offsets[k]:offsets[k] + len(w)].tolist()
            w = [x for x, g in zip(w, gone) if not g]
        yield list(zip((start[lo:hi] - offsets[k]).tolist(), length[lo:hi].tolist(), period[lo:hi].tolist())), b" ".join(w)


def collapse_runs(df: DataFrame, id_col: str, text_col: str, min_length: int = 12) -> DataFrame:
    """(id, runs, collapsed): each text's runs, by start and period, in word numbers from 0, and its words joined by
    one space without those that any run contains after its first period."""
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def work(batches):
        for batch in batches:
            at = 0
            for part in portions(batch.column(1).to_pylist()):
                out = list(_portion(part, min_length))
                runs = pa.array([[dict(zip(("start", "length", "period"), r)) for r in rs] for rs, _ in out], pa.list_(run))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), runs, pa.array([c for _, c in out], pa.binary()).cast(pa.string())],
                    names=["id", "runs", "collapsed"])
                at += len(part)

    slim = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return slim.mapInArrow(work, SCHEMA.format(df.schema[id_col].dataType.simpleString()))


def longest(runs) -> F.Column:
    """The run with the greatest length, ties by smallest start, then period; null without runs."""
    best = F.array_min(F.transform(runs, lambda r: F.struct((-r.length).alias("l"), r.start.alias("s"), r.period.alias("q"))))
    return F.when(best.isNotNull(), F.struct(best.s.alias("start"), (-best.l).alias("length"), best.q.alias("period")))


def tail_repeated(words, seed) -> F.Column:
    """An array of ``n`` words as a text in which, from word ``a`` on, the ``p`` words from ``a`` are repeated:
    ``a = seed % n`` and ``p = 1 + floor((n - a) / (3 + seed % 8))``. A planted repetition, to measure with."""
    def whole(w):
        n = F.size(w).cast("long")
        a = seed % F.greatest(n, F.lit(1))
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + seed % 8))
        word = lambda i: F.element_at(w, (F.when(i < a, i).otherwise(a + (i - a) % p) + 1).cast("int"))
        return F.when(n == 0, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), word), " "))

    return F.element_at(F.transform(F.array(words), whole), 1)  # the words bound once
