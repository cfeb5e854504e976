"""Operator 7: SentencePiece encoding and decoding.

An Aho-Corasick automaton over the vocabulary's pieces reads a text once; at every position its output links
give the pieces that end there, and the best of them is relaxed into the Viterbi table.

* Unigram models: the best path is the one with the largest sum of piece scores.
* BPE models (``piece_bpe_32k.model``): sums of merge ranks would not give the library's pieces, so the path
  score is the merge order itself: a piece may follow another only if merging the two pieces' letters gives
  exactly these two pieces again. A prefix then has exactly one admissible last piece, so the single survivor
  at each position is the library's encoding. Admissible pairs are decided once and cached.

White space is written as the mark U+2581, a mark is put in front, and no piece holds a mark after a letter,
so runs of letters between marks are coded on their own and kept in a cache per worker that is bounded in bytes. Runs of up to
``LONGEST`` letters that are not in it are coded together, column by column over arrays (``Columns``); longer
ones one at a time (``Codec.run``): the same pass of the same automaton. Letters without a piece become byte
pieces. Decoding joins pieces and bytes and drops the mark in front.

Defined cases: null texts give null ids; empty texts give no ids; repeated rows are coded each; other columns
are kept (clashing ``ids`` and ``decoded`` columns are replaced); an empty table gives no rows. A text that holds U+2581 comes
back with spaces there, as with the library. The model must use the identity normaliser.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
CACHE_BYTES = 8 << 20  # of one generation of coded runs
RUN_BYTES = 260  # a run's objects and its place in the table, besides its letters
PAIR_CACHE = 1 << 16
LONGEST = 64
PAIRS = 1 << 20  # decided pairs a worker keeps as arrays (9 MB)
CHUNK = 1 << 15  # runs coded at once
_RUN = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")


class Columns:
    """The automaton as arrays: codes many short runs at once, one position of all of them per step.

    ``out`` and ``more`` are the output links: the node of the longest piece that ends at a node, and of the
    next shorter one (0: none)."""

    def __init__(self, codec: "Codec"):
        self.codec = codec
        letters = sorted({x for p in codec.normal for x in p})
        self.width = len(letters) + 1
        self.letter = np.zeros(0x110000, dtype=np.int32)  # code point -> column, 0: in no piece
        self.letter[[ord(x) for x in letters]] = np.arange(1, self.width)
        known = {x: i + 1 for i, x in enumerate(letters)}
        children: list[dict[int, int]] = [{}]
        piece, size = [-1], [0]
        for p, i in codec.normal.items():
            node = 0
            for x in p:
                step = children[node].setdefault(known[x], len(children))
                if step == len(children):
                    children.append({})
                    piece.append(-1)
                    size.append(0)
                node = step
            piece[node], size[node] = i, len(p)
        fail, out, more, level = [0] * len(children), [0] * len(children), [0] * len(children), [0]
        while level:  # breadth first: a node's fail node lies nearer to the root
            below = []
            for node in level:
                for x, child in children[node].items():
                    at = fail[node]
                    while node and at and x not in children[at]:
                        at = fail[at]
                    fail[child] = children[at].get(x, 0) if node else 0
                    longest = out[fail[child]]
                    out[child], more[child] = (child, longest) if piece[child] >= 0 else (longest, 0)
                    below.append(child)
            level = below
        edges = sorted((node * self.width + x, child) for node, c in enumerate(children) for x, child in c.items())
        self.edges, self.targets = np.array(edges or [(-1, 0)], dtype=np.int64).T.copy()
        self.fail, self.out, self.more = (np.array(v, dtype=np.int64) for v in (fail, out, more))
        self.piece, self.size = np.array(piece, dtype=np.int64), np.array(size, dtype=np.int64)
        self.pair_keys, self.pair_ok = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
        self.scores = np.array(codec.scores, dtype=np.float64)

    def _step(self, states: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The nodes after one more letter, following fail links where there is no edge."""
        out = np.zeros(len(states), dtype=np.int64)
        open_ = np.flatnonzero(letters)
        states = states[open_]
        while len(open_):
            keys = states * self.width + letters[open_]
            at = np.minimum(np.searchsorted(self.edges, keys), len(self.edges) - 1)
            hit = self.edges[at] == keys
            out[open_[hit]] = self.targets[at[hit]]
            left = ~hit & (states > 0)
            open_, states = open_[left], self.fail[states[left]]
        return out

    def _admissible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``Codec.admissible`` of many pairs; pairs met for the first time are decided once each."""
        keys = (left + 1) * len(self.codec.texts) + right
        if not len(keys):
            return np.zeros(0, dtype=bool)

        def found():
            at = np.searchsorted(self.pair_keys, keys)
            near = np.minimum(at, max(0, len(self.pair_keys) - 1))
            return near, (self.pair_keys[near] == keys) if len(self.pair_keys) else np.zeros(len(keys), dtype=bool)

        near, hit = found()
        out = np.zeros(len(keys), dtype=bool)
        out[hit] = self.pair_ok[near[hit]]
        if not hit.all():
            new, back = np.unique(keys[~hit], return_inverse=True)
            vocabulary = len(self.codec.texts)
            ok = np.array([self.codec.decided(k // vocabulary - 1, k % vocabulary) for k in new.tolist()], dtype=bool)
            out[~hit] = ok[back]
            if len(self.pair_keys) + len(new) <= PAIRS:
                at = np.searchsorted(self.pair_keys, new)
                self.pair_keys, self.pair_ok = np.insert(self.pair_keys, at, new), np.insert(self.pair_ok, at, ok)
        return out

    def code(self, runs: list[str]) -> list[bytes]:
        """Ids of each of ``runs``, none longer than ``LONGEST`` letters, as the bytes of an int32 array."""
        order = sorted(range(len(runs)), key=lambda i: len(runs[i]), reverse=True)
        out: list = [b""] * len(runs)
        for lo in range(0, len(order), CHUNK):
            some = order[lo:lo + CHUNK]
            for i, ids in zip(some, self._coded([runs[i] for i in some])):
                out[i] = ids
        return out

    def _coded(self, runs: list[str]) -> list[bytes]:
        """``code`` for a chunk of runs, longest first."""
        sizes = np.array([len(r) for r in runs], dtype=np.int64)
        codes = self.letter[np.frombuffer("".join(runs).encode("utf-32-le"), np.uint32)].astype(np.int64)
        first = np.cumsum(sizes) - sizes
        n, longest = len(runs), int(sizes[0]) if len(runs) else 0
        came = np.zeros((longest + 1, n), dtype=np.int16)  # by position: where its last piece starts
        last = np.full((longest + 1, n), -1, dtype=np.int32)  # and that piece (-1: a letter that stands alone)
        best = np.zeros((longest + 1, n)) if self.codec.kind == "unigram" else None
        states = np.zeros(n, dtype=np.int64)
        for end in range(1, longest + 1):
            live = int(np.searchsorted(-sizes, -end, side="right"))  # runs with a letter here
            states = self._step(states[:live], codes[first[:live] + end - 1])
            came[end, :live] = end - 1
            if best is not None:
                best[end, :live] = best[end - 1, :live] - 1e6
            settled = np.zeros(live, dtype=bool)
            links = self.out[states]
            rows = np.flatnonzero(links)
            links = links[rows]
            while len(rows):
                piece, start = self.piece[links], end - self.size[links]
                if best is None:
                    good = self._admissible(last[start, rows].astype(np.int64), piece)
                    going = ~good
                else:
                    score = best[start, rows] + self.scores[piece]
                    good = ~settled[rows] | (score > best[end, rows])
                    best[end, rows[good]] = score[good]
                    going = np.ones(len(rows), dtype=bool)
                settled[rows[good]] = True
                came[end, rows[good]], last[end, rows[good]] = start[good], piece[good]
                links = self.more[links]
                going &= links > 0
                rows, links = rows[going], links[going]
        rows, at, steps = np.arange(n), sizes.copy(), []
        while len(rows):
            steps.append((rows, last[at, rows]))
            at = came[at, rows].astype(np.int64)
            rows, at = rows[at > 0], at[at > 0]
        if not steps:
            return []
        owner, ids = np.concatenate([s[0] for s in steps][::-1]), np.concatenate([s[1] for s in steps][::-1])
        alone = set(owner[ids < 0].tolist())  # runs with byte pieces
        ids = ids[np.argsort(owner, kind="stable")].astype(np.int32).tobytes()
        ends = (4 * np.cumsum(np.bincount(owner, minlength=n))).tolist()
        return [self.codec.run(runs[i]) if i in alone else ids[a:b] for i, (a, b) in enumerate(zip([0, *ends], ends))]


class Codec:
    """Encoder and decoder over a table of pieces."""

    def __init__(self, pieces: list[tuple[str, float, str]], kind: str = "bpe"):
        """``pieces``: (piece, score, 'normal' | 'byte' | 'unknown' | 'control') by id; ``kind``: bpe or unigram."""
        import ahocorasick

        self.kind = kind
        self.normal = {p: i for i, (p, _, t) in enumerate(pieces) if t == "normal"}
        self.scores = [s for _, s, _ in pieces]
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == "byte"}
        self.unknown = next((i for i, (_, _, t) in enumerate(pieces) if t == "unknown"), 0)
        self.texts = [p if t == "normal" else "" for p, _, t in pieces]
        self.byte_of = {i: b for b, i in self.bytes.items()}
        if any(MARK in p.lstrip(MARK) for p in self.normal):
            raise ValueError("a piece holds a space mark after a letter; runs can't be coded on their own")
        if any("\n" in p and p != "\n" for p in self.normal):
            raise ValueError("a piece joins a line break to other letters")
        self.automaton = ahocorasick.Automaton()
        for p, i in self.normal.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.runs: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        self.columns = Columns(self)

    @classmethod
    def of_file(cls, model: bytes, kind: str = "bpe") -> "Codec":
        return cls(pieces_of(model), kind)

    def _merged(self, text: str) -> list[str]:
        """Pieces of a short string by merging the best-scored neighbours first, leftmost on ties."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                n = self.normal.get(parts[k] + parts[k + 1])
                if n is not None and (best is None or self.scores[n] > best):
                    best, at = self.scores[n], k
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def admissible(self, left: int, right: int) -> bool:
        """May ``right`` follow ``left`` (-1: nothing ahead)?"""
        key = (left, right)
        got = self.pairs.get(key)
        if got is None:
            got = self.decided(left, right)
            if len(self.pairs) < PAIR_CACHE:
                self.pairs[key] = got
        return got

    def decided(self, left: int, right: int) -> bool:
        """``admissible`` by merging the letters of both."""
        a, b = self.texts[left] if left >= 0 else "", self.texts[right]
        return self._merged(a + b) == ([a, b] if a else [b])

    def run(self, text: str) -> bytes:
        """Ids of one run, as the bytes of an int32 array: a single pass of the automaton with one survivor a position."""
        n = len(text)
        back = [(0, -1)] * (n + 1)  # (start of the last piece, its id)
        best = [0.0] + [float("-inf")] * n
        done = 0
        for end, (piece, size) in chain(self.automaton.iter(text), [(n, (-1, 0))]):
            while done < end:  # all pieces that end at ``done`` are in; a letter without a piece stands alone
                done += 1
                if best[done] == float("-inf"):
                    back[done], best[done] = (done - 1, -1), best[done - 1] - 1e6
            if not size:
                break
            start, at = end + 1 - size, end + 1
            if self.kind == "unigram":
                score = best[start] + self.scores[piece]
                if score > best[at]:
                    best[at], back[at] = score, (start, piece)
            elif best[at] == float("-inf") and self.admissible(back[start][1] if start else -1, piece):
                best[at], back[at] = 0.0, (start, piece)
        ids, at = [], n
        while at:
            start, piece = back[at]
            if piece >= 0:
                ids.append(piece)
            else:
                codes = [self.bytes.get(b, self.unknown) for b in text[start:at].encode()] if self.bytes else [self.unknown]
                ids.extend(reversed(codes))
            at = start
        return np.array(ids[::-1], dtype=np.int32).tobytes()

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list) -> list:
        """Ids of every text (None for None)."""
        return [None if x is None else x.tolist() for x in self.encode_arrays(texts)]

    def encode_arrays(self, texts: list) -> list:
        """Ids of every text as an int32 array (None for None).

        Coded runs are kept as bytes in two generations: when the younger is over ``CACHE_BYTES`` it becomes the older,
        whose runs are forgotten unless they have come again since."""
        split = [_RUN.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = set()
        for runs in split:
            new.update(runs)
        young, old, here = self.runs, self.older, {}
        todo = []
        for r in new:
            if r not in young:
                if len(r) > LONGEST:
                    here[r] = self.run(r)
                elif r in old:
                    young[r] = old[r]
                    self.held += RUN_BYTES + 2 * len(r)
                else:
                    todo.append(r)
        for lo in range(0, len(todo), CHUNK):
            some = todo[lo:lo + CHUNK]
            young.update(zip(some, self.columns.code(some)))
            self.held += sum(map(len, some)) * 2 + RUN_BYTES * len(some)
        get = (lambda r: young[r] if r in young else here[r]) if here else young.__getitem__
        out = [None if t is None else np.frombuffer(b"".join(map(get, runs)), np.int32) for t, runs in zip(texts, split)]
        if self.held > CACHE_BYTES:
            self.older, self.runs, self.held = young, {}, 0
        return out

    def decode(self, ids) -> str:
        out, pending = [], bytearray()
        for i in ids:
            byte = self.byte_of.get(i)
            if byte is not None:
                pending.append(byte)
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending.clear()
            out.append(self.texts[i])
        if pending:
            out.append(pending.decode("utf-8", "replace"))
        text = "".join(out).replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


def pieces_of(model: bytes) -> list[tuple[str, float, str]]:
    """The piece table of a model file, read through the library."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_proto=model)
    kind = lambda i: ("unknown" if sp.is_unknown(i) else "control" if sp.is_control(i) else "byte" if sp.is_byte(i)
                      else "unused" if sp.is_unused(i) else "normal")
    return [(sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.vocab_size())]


_WORKER: dict = {}


def _codec(table) -> Codec:
    pieces, kind = table.value
    key = (len(pieces), hash(tuple(pieces[:1000])), kind)
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Codec(pieces, kind)
    return _WORKER[key]


def _slices(column, size: int = 2 << 20):
    """(start, length) of consecutive rows of about ``size`` bytes of text each."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64) + 1
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = max(int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, side="right")), lo + 1)
        yield lo, hi - lo
        lo = hi


def _through(docs: DataFrame, text_col: str, model: bytes, kind: str, decode: bool) -> DataFrame:
    table = docs.sparkSession.sparkContext.broadcast((pieces_of(model), kind))
    added = ["ids", "decoded"] if decode else ["ids"]
    kept = [f for f in docs.schema.fields if f.name not in added]
    schema = T.StructType([*kept, T.StructField("ids", T.ArrayType(T.IntegerType())), *([T.StructField("decoded", T.StringType())] if decode else [])])

    def work(batches):
        codec = _codec(table)
        for batch in batches:
            texts = batch.column(text_col)
            for lo, n in _slices(texts):
                ids = codec.encode_arrays(texts.slice(lo, n).to_pylist())
                none = np.array([x is None for x in ids])
                ends = np.cumsum([0 if x is None else len(x) for x in ids])
                offsets = pa.array(np.append(0, ends).astype(np.int32), mask=np.append(none, False))
                flat = np.concatenate([x for x in ids if x is not None] or [np.zeros(0, np.int32)])
                columns = [pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))]
                if decode:
                    columns.append(pa.array((None if x is None else codec.decode(x.tolist()) for x in ids), pa.string(), size=n))
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name).slice(lo, n) for f in kept), *columns], names=schema.names)

    return docs.select([f.name for f in kept] if text_col not in added else docs.columns).mapInArrow(work, schema)


def encoded(docs: DataFrame, text_col: str, model: bytes, kind: str = "bpe") -> DataFrame:
    """``docs`` with ``ids``, the array of piece ids of each whole text. The piece table is broadcast (the
    vocabulary file bounds it). Portions of about 2 MB of text are coded at a time."""
    return _through(docs, text_col, model, kind, decode=False)


def round_trip(docs: DataFrame, text_col: str, model: bytes, kind: str = "bpe") -> DataFrame:
    """``encoded`` with ``decoded``, the text of each array of ids, made in the same pass."""
    return _through(docs, text_col, model, kind, decode=True)


def decoded(rows: DataFrame, ids_col: str, model: bytes, kind: str = "bpe") -> DataFrame:
    """``rows`` with ``decoded``, the text of each array of ids."""
    table = rows.sparkSession.sparkContext.broadcast((pieces_of(model), kind))

    @F.pandas_udf("string")
    def text(arrays):
        codec = _codec(table)
        return pd.Series([None if a is None else codec.decode(a.tolist()) for a in arrays], dtype=object)

    return rows.withColumn("decoded", text(F.col(ids_col)))
