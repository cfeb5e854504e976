"""Operator 1: LM scoring by context-tree weighting over bytes.

A text is the byte stream of its words (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased) joined by one space and
ended by one newline, so the stream spells exactly the token sequence "words, then end". The model
(``ctw_model``) counts, for every context of 0 to 6 bytes, the binary decisions of the next byte over all
training texts and mixes the Krichevsky-Trofimov estimates of all depths.

How it runs (all heavy parts are spread by Spark; nothing is sampled or cut):

1. ``blocks``: texts are packed into blocks of about 16 MB of stream and written to the shared folder.
2. Every block sends its sorted distinct grams and word hashes, with training counts, to buckets. A bucket
   holds whole subtrees (it is chosen by the two most recent context bytes), so pre-aggregated counts meet
   there once; the shuffle carries distinct grams of blocks, never positions.
3. A bucket merges counts and computes log Pw for depths 6 to 2. Depths 1 and 0 need sums with at most
   65,536 + 65,280 keys; these bounded tables are mixed on the driver and broadcast (at most 12 MB).
4. Buckets answer each block with one probability per distinct gram and one count per distinct word; a
   block turns them into scores of its documents.

Defined cases: null text counts as empty (one token, the end); a null id belongs to the training part;
repeated rows are scored each; an empty table gives no rows; further columns are ignored. A block holds
whole texts, so the memory of a task is bounded by 16 MB of stream or one text. Word counts are keyed by
64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlens.llm import ctw_model as M
from termlens.llm.common import mixed, span_hashes, squeeze, unsqueeze, written

BLOCK_BYTES = 16 << 20
PART_BYTES = 3 << 20  # a block is worked on in parts of about this size
MIN_BUCKETS, MAX_BUCKETS = 96, 4096  # buckets grow with the blocks
PAD = b"\n" * M.DEPTH
CTX = np.uint64(8 * (M.DEPTH - 1))  # a gram shifted by this is its two most recent context bytes

BLOCKS = ("block long, ids array<long>, train array<boolean>, lengths array<long>, words array<long>, "
          "docs array<long>, sizes array<long>, streams array<binary>")
CHUNKS = "bucket int, block long, grams binary, counts binary, words binary, word_counts binary"
MODEL = ("bucket int, grams binary, counts binary, types long, tokens long, keys array<int>, sums array<double>, "
         "blocks array<long>, grams_at array<binary>, word_counts array<binary>")
ANSWERS = "block long, bucket int, log10s binary, word_counts binary"
SCORES = "id long, n_tokens long, n_known long, base double, score double, n_bytes long"


def _stage(batches):
    """Pack (id, train, text) rows into blocks of streams; every text is preceded by a padding of newlines."""
    part, made = TaskContext.get().partitionId(), 0
    ids, train, lengths, words, docs, sizes, packed, streams = [], [], [], [], [], [], [], []
    size = 0

    def close():
        stream = b"".join(streams)
        packed.append(pa.compress(stream, codec="zstd", asbytes=True))
        sizes.append(len(stream))
        docs.append(len(ids) - sum(docs))

    def block():
        return pa.RecordBatch.from_pydict({
            "block": [(part << 32) + made], "ids": [ids], "train": [train], "lengths": [lengths], "words": [words], "docs": [docs],
            "sizes": [sizes], "streams": [packed],
        }, schema=pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())),
                             ("lengths", pa.list_(pa.int64())), ("words", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64())),
                             ("sizes", pa.list_(pa.int64())), ("streams", pa.list_(pa.binary()))]))

    for batch in batches:
        for key, known, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            tokens = text.encode().lower().split() if text else []
            stream = b" ".join(tokens) + b"\n"
            ids.append(key)
            train.append(known)
            lengths.append(len(stream))
            words.append(len(tokens))
            streams += [PAD, stream]
            size += len(stream)
            if size >= PART_BYTES:
                close()
                streams, size = [], 0
                if sum(sizes) >= BLOCK_BYTES:
                    yield block()
                    made += 1
                    ids, train, lengths, words, docs, sizes, packed = [], [], [], [], [], [], []
    if streams:
        close()
    if ids:
        yield block()


class _Part:
    """A part's grams and words, in stream order, with their documents."""

    def __init__(self, lengths, words, size, stream):
        raw = np.frombuffer(pa.decompress(stream, decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
        self.lengths, self.words, self.docs = lengths, words, len(lengths)
        last = np.cumsum(self.lengths + M.DEPTH)
        keep = np.ones(size, dtype=bool)
        for d in range(M.DEPTH):
            keep[last - self.lengths - 1 - d] = False
        self.grams = M.pack(raw)[keep]
        inside = (raw != 32) & (raw != 10)
        edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.hashes = span_hashes(raw, starts, ends)

    def of_bytes(self, per_doc):
        return np.repeat(per_doc, self.lengths)

    def of_words(self, per_doc):
        return np.repeat(per_doc, self.words)


def _parts(lengths, words, docs, sizes, streams):
    """(first document, part) of a block, one at a time."""
    lengths, words, at = np.asarray(lengths, dtype=np.int64), np.asarray(words, dtype=np.int64), 0
    for n, size, stream in zip(docs, sizes, streams):
        yield at, _Part(lengths[at:at + n], words[at:at + n], int(size), stream)
        at += n


def _merged(found):
    """Sorted distinct keys of several (keys, counts), with summed counts."""
    keys = _distinct(np.concatenate([k for k, _ in found]))
    counts = np.zeros(len(keys), dtype=np.int64)
    for k, c in found:
        counts[np.searchsorted(keys, k)] += c
    return keys, counts


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def _counted(values: np.ndarray, train: np.ndarray):
    """Sorted distinct values, and how often each occurs among the training ones."""
    keys = _distinct(values)
    counts = np.zeros(len(keys), dtype=np.int64)
    chosen = np.sort(values[train])
    if len(chosen):
        first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
        counts[np.searchsorted(keys, chosen[first])] = np.diff(np.append(first, len(chosen)))
    return keys, counts


def _dealt(keys: np.ndarray, buckets: int, of_context: bool):
    """Order of the keys by bucket (stable), and the bounds of the buckets in that order."""
    bucket = (mixed(keys >> CTX if of_context else keys) % np.uint64(buckets)).astype(np.uint16)
    return np.argsort(bucket, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))])


def _chunks(buckets: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                train = np.asarray(row["train"], dtype=bool)
                grams, hashes = [], []
                for at, b in _parts(row["lengths"], row["words"], row["docs"], row["sizes"], row["streams"]):
                    known = train[at:at + b.docs]
                    grams.append(_counted(b.grams, b.of_bytes(known)))
                    hashes.append(_counted(b.hashes, b.of_words(known)))
                grams, counts = _merged(grams)
                hashes, word_counts = _merged(hashes)
                order, at = _dealt(grams, buckets, True)
                grams, counts = grams[order], counts[order]
                order, word_at = _dealt(hashes, buckets, False)
                hashes, word_counts = hashes[order], word_counts[order]
                rows = []
                for k in range(buckets):
                    g, w = slice(at[k], at[k + 1]), slice(word_at[k], word_at[k + 1])
                    if at[k] < at[k + 1] or word_at[k] < word_at[k + 1]:
                        rows.append((k, row["block"], squeeze(np.diff(grams[g], prepend=np.uint64(0))),
                                     squeeze(counts[g]), squeeze(hashes[w]), squeeze(word_counts[w])))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()),
                     *[pa.array(c, pa.binary()) for c in columns[2:]]],
                    names=["bucket", "block", "grams", "counts", "words", "word_counts"])
    return run


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    """One bucket: merged counts of all blocks, the parts of the shallow tables, and where each block's grams are."""
    grams = [np.cumsum(unsqueeze(x, np.uint64), dtype=np.uint64) for x in rows.grams]
    hashes = [unsqueeze(x, np.uint64) for x in rows.words]
    keys, types = _distinct(np.concatenate(grams)), _distinct(np.concatenate(hashes))
    counts, type_counts = np.zeros(len(keys), dtype=np.int64), np.zeros(len(types), dtype=np.int64)
    grams_at, words_at = [], []
    for g, c, w, n in zip(grams, rows.counts, hashes, rows.word_counts):
        at, word_at = np.searchsorted(keys, g), np.searchsorted(types, w)
        counts[at] += unsqueeze(c, np.int64)
        type_counts[word_at] += unsqueeze(n, np.int64)
        grams_at.append(squeeze(np.diff(at, prepend=0).astype(np.uint32)))
        words_at.append(word_at)
    levels, _ = M.deep_levels(keys, counts.astype(float))
    top = levels[M.SHALLOW]
    sums = {}
    context = (top.keys >> np.uint64(16)).astype(np.int64)
    cells, at = np.unique(context * 256 + (top.keys & np.uint64(255)).astype(np.int64), return_inverse=True)
    sums.update(zip(cells.tolist(), np.bincount(at.reshape(-1), weights=top.counts).tolist()))
    for b in range(M.BITS):
        first = np.flatnonzero(np.diff(top.node[b], prepend=-1))
        node = (1 << b) + ((top.keys[first] & np.uint64(255)) >> np.uint64(8 - b)).astype(np.int64)
        cells, at = np.unique(65536 + context[first] * 256 + node, return_inverse=True)
        sums.update(zip(cells.tolist(), np.bincount(at.reshape(-1), weights=top.log_pw[b]).tolist()))
    return pd.DataFrame([{
        "bucket": int(rows.bucket.iloc[0]), "grams": squeeze(np.diff(keys, prepend=np.uint64(0))), "counts": squeeze(counts),
        "types": int((type_counts > 0).sum()), "tokens": int(type_counts.sum()), "keys": list(sums), "sums": list(sums.values()),
        "blocks": rows.block.tolist(), "grams_at": grams_at,
        "word_counts": [squeeze(type_counts[at]) for at in words_at]}])


def _answers(maps):
    def run(batches):
        add_times_own = tuple(maps.value)
        for batch in batches:
            for row in batch.to_pylist():
                keys = np.cumsum(unsqueeze(row["grams"], np.uint64), dtype=np.uint64)
                levels, ups = M.deep_levels(keys, unsqueeze(row["counts"], np.int64).astype(float))
                log10s = M.log10_probability(keys, *M.deep_estimates(levels, ups), add_times_own).astype(np.float32)
                for block, at, counts in zip(row["blocks"], row["grams_at"], row["word_counts"]):
                    at = np.cumsum(unsqueeze(at, np.uint32), dtype=np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block], pa.int64()), pa.array([row["bucket"]], pa.int32()),
                         pa.array([squeeze(log10s[at])], pa.binary()), pa.array([counts], pa.binary())],
                        names=["block", "bucket", "log10s", "word_counts"])
    return run


def _doc_sums(b: _Part, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Per document the sum of its grams' values: 256 documents at a time, sorted as (gram, document)."""
    out, end = np.zeros(b.docs), np.cumsum(b.lengths)
    for lo in range(0, b.docs, 256):
        hi = min(b.docs, lo + 256)
        part = b.grams[end[lo] - b.lengths[lo]:end[hi - 1]]
        pairs = np.sort((part << np.uint64(8)) | np.repeat(np.arange(hi - lo, dtype=np.uint64), b.lengths[lo:hi]))
        gram = pairs >> np.uint64(8)
        first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        value = np.repeat(values[np.searchsorted(keys, gram[first])], np.diff(np.append(first, len(gram))))
        out[lo:hi] = np.bincount((pairs & np.uint64(255)).astype(np.int64), weights=value, minlength=hi - lo)
    return out


def _finish(buckets: int, tokens: int, types: int, ends: int):
    floor = math.log10(tokens + types + 1)

    def run(staged: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        answers = answers.sort_values("bucket")
        log10s = np.concatenate([unsqueeze(x, np.float32) for x in answers.log10s])
        counts = np.concatenate([unsqueeze(x, np.int64) for x in answers.word_counts])
        for row in staged.itertuples():
            named = [row.lengths, row.words, row.docs, row.sizes, row.streams]
            found = [(_distinct(b.grams), _distinct(b.hashes)) for _, b in _parts(*named)]
            keys, hashes = (_distinct(np.concatenate(x)) for x in zip(*found))
            del found
            order, _ = _dealt(keys, buckets, True)
            value = np.empty(len(keys))
            value[order] = log10s
            order, _ = _dealt(hashes, buckets, False)
            count = np.empty(len(hashes), dtype=np.int64)
            count[order] = counts
            for at, b in _parts(*named):
                seen = count[np.searchsorted(hashes, b.hashes)]
                doc = b.of_words(np.arange(b.docs))
                base = np.bincount(doc, weights=np.log10(seen + 1.0), minlength=b.docs) + math.log10(ends + 1) - (b.words + 1) * floor
                known = np.bincount(doc, weights=seen > 0, minlength=b.docs).astype(np.int64) + (ends > 0)
                out.append(pd.DataFrame({"id": pd.array(list(row.ids[at:at + b.docs]), dtype="Int64"), "n_tokens": b.words + 1,
                                         "n_known": known, "base": base, "score": _doc_sums(b, keys, value), "n_bytes": b.lengths}))
        return pd.concat(out)
    return run


def score(docs: DataFrame, id_col: str, text_col: str, train) -> DataFrame:
    """Score every row of ``docs`` under a model learnt from the rows where ``train`` (a boolean column) holds.

    Returns (id, n_tokens, n_known, base, score, n_bytes, train_tokens, code_length): ``score`` is the log10
    probability of the text, ``code_length`` its bits per byte, ``base`` the add-one unigram score."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).alias("text"))
    staged = written(rows.mapInArrow(_stage, BLOCKS), "ctw-blocks")
    shape = staged.agg(F.count("*").alias("blocks"),
                       F.sum(F.size(F.filter("train", lambda x: x))).alias("ends")).first()
    buckets, ends = min(MAX_BUCKETS, max(MIN_BUCKETS, shape.blocks)), int(shape.ends or 0)
    chunks = staged.mapInArrow(_chunks(buckets), CHUNKS)
    model = written(chunks.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(_merge, MODEL), "ctw-model")
    totals = model.agg(F.sum("types").alias("types"), F.sum("tokens").alias("tokens")).first()
    tokens, types = int(totals.tokens or 0) + ends, int(totals.types or 0) + (ends > 0)
    shallow = (model.select(F.explode(F.arrays_zip("keys", "sums")).alias("x")).groupBy("x.keys")
               .agg(F.sum("x.sums").alias("s")).toPandas())  # at most 130,816 rows
    cells = np.zeros(131072)
    cells[shallow["keys"].to_numpy(dtype=np.int64)] = shallow["s"].to_numpy(dtype=float)
    counts1, heap = cells[:65536].reshape(256, 256), cells[65536:].reshape(256, 256)
    below = np.zeros((256, 8, 256))
    for b in range(8):
        below[:, b, :1 << b] = heap[:, 1 << b:2 << b]
    maps = spark.sparkContext.broadcast(M.shallow_maps(counts1, below))
    answers = model.mapInArrow(_answers(maps), ANSWERS)
    scored = staged.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_finish(buckets, tokens, types, ends), SCORES)
    return (scored.withColumn("train_tokens", F.lit(tokens).cast("long"))
            .withColumn("code_length", -F.col("score") * math.log2(10) / F.col("n_bytes")))
