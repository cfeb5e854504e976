"""Context-tree weighting arithmetic over sorted distinct byte grams (numpy, used inside Spark tasks).

A gram packs ``DEPTH`` context bytes and one symbol into an integer: the most recent context byte is the
highest byte, the oldest the one above the symbol, the symbol the lowest. A symbol is coded as 8 binary
decisions, most significant bit first, so a node is (context of depth d, leading bits of the symbol).

Every node holds the counts (zeros, ones) of the training bytes, the Krichevsky-Trofimov probability
``Pe`` of those bits and the weighted probability ``Pw = (Pe + prod Pw(children)) / 2`` (``Pw = Pe`` at
full depth); children lengthen the context by one older byte. The predictive probability of a bit mixes
all depths: ``q_d = w_d * KT_d + (1 - w_d) * q_{d+1}`` with ``w_d = Pe / (2 Pw)``. A node without training
bits hands on the estimate of its parent, so unseen contexts fall back to the longest seen one.
"""

from __future__ import annotations

import numpy as np

DEPTH = 6  # context bytes; the packed gram is (DEPTH + 1) bytes
SHALLOW = 2  # depths below this one are mixed from tables of at most 65,536 entries
BITS = 8
LN2 = float(np.log(2.0))
_TABLE = 1 << 16
_HALF = np.concatenate([[0.0], np.cumsum(np.log(np.arange(_TABLE - 1) + 0.5))])
_FACT = np.concatenate([[0.0], np.cumsum(np.log(np.arange(_TABLE - 1) + 1.0))])


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series; used for arguments of 65,536 and more only."""
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def _rising(table: np.ndarray, n: np.ndarray, shift: float, start: float) -> np.ndarray:
    """log of (shift)(shift+1)...(shift+n-1); ``start`` is log gamma(shift)."""
    n = np.asarray(n, dtype=np.int64)
    out = table[np.minimum(n, _TABLE - 1)]
    big = n >= _TABLE
    if big.any():
        out = out.copy()
        out[big] = _log_gamma(n[big] + shift) - start
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov block probability."""
    return (_rising(_HALF, zeros, 0.5, 0.5 * np.log(np.pi)) + _rising(_HALF, ones, 0.5, 0.5 * np.log(np.pi))
            - _rising(_FACT, np.asarray(zeros) + ones, 1.0, 0.0))


class Level:
    """The nodes of one depth over sorted distinct keys ``context << 8 | symbol`` with counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts
        self.node, self.n, self.ones, self.log_pe, self.log_pw = [], [], [], [], []
        symbol = keys & np.uint64(255)
        for b in range(BITS):
            prefix = keys >> np.uint64(BITS - b)
            node = np.zeros(len(keys), dtype=np.int32)
            if len(keys):
                np.cumsum(prefix[1:] != prefix[:-1], out=node[1:])
            size = int(node[-1]) + 1 if len(keys) else 0
            bit = (symbol >> np.uint64(7 - b)) & np.uint64(1)
            n = np.bincount(node, weights=counts, minlength=size)
            ones = np.bincount(node, weights=counts * bit, minlength=size)
            self.node.append(node)
            self.n.append(n)
            self.ones.append(ones)
            self.log_pe.append(log_kt(n - ones, ones))

    def weigh(self, child: "Level | None" = None, up: np.ndarray | None = None,
              below: list[np.ndarray] | None = None) -> None:
        """Fill ``log_pw``. ``up`` maps the child's entries to entries here; ``below`` may give the sums of
        the children's log Pw per node directly (for the shallow depths, where children come from tasks)."""
        for b in range(BITS):
            if child is None and below is None:
                self.log_pw.append(self.log_pe[b])
                continue
            if below is not None:
                total = below[b]
            else:
                first = np.flatnonzero(np.diff(child.node[b], prepend=-1))
                total = np.bincount(self.node[b][up[first]], weights=child.log_pw[b], minlength=len(self.n[b]))
            self.log_pw.append(np.logaddexp(self.log_pe[b], total) - LN2)

    def kt(self, b: int) -> np.ndarray:
        """KT predictive probability, per entry, of the entry's own bit b."""
        bit = (self.keys >> np.uint64(7 - b)) & np.uint64(1)
        node = self.node[b]
        own = np.where(bit == 1, self.ones[b][node], (self.n[b] - self.ones[b])[node])
        return (own + 0.5) / (self.n[b][node] + 1.0)

    def own_weight(self, b: int) -> np.ndarray:
        """Per entry: posterior weight of this depth's own estimate at bit b."""
        return np.exp(np.minimum(self.log_pe[b] - LN2 - self.log_pw[b], 0.0))[self.node[b]]


def parents(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys with the oldest context byte dropped: (sorted distinct parent keys, index of each key's parent)."""
    up = ((keys >> np.uint64(16)) << np.uint64(8)) | (keys & np.uint64(255))
    return np.unique(up, return_inverse=True)


def deep_levels(grams: np.ndarray, counts: np.ndarray, depth: int = DEPTH, shallow: int = SHALLOW):
    """Levels ``depth`` down to ``shallow`` with log Pw, and the index maps between them."""
    levels, ups = {depth: Level(grams, counts)}, {}
    levels[depth].weigh()
    for d in range(depth - 1, shallow - 1, -1):
        child = levels[d + 1]
        keys, up = parents(child.keys)
        up = up.reshape(-1)
        levels[d] = Level(keys, np.bincount(up, weights=child.counts, minlength=len(keys)))
        levels[d].weigh(child, up)
        ups[d] = up
    return levels, ups


def deep_estimates(levels: dict, ups: dict, depth: int = DEPTH, shallow: int = SHALLOW):
    """Per gram and bit: the mixed estimate from depth ``shallow`` downwards, and whether that node was seen.

    Returns (q, seen), arrays of shape (8, grams); ``q`` is meaningless where ``seen`` is false."""
    grams = levels[depth].keys
    index = {depth: np.arange(len(grams))}
    for d in range(depth - 1, shallow - 1, -1):
        index[d] = ups[d][index[d + 1]]
    q = np.empty((BITS, len(grams)))
    seen = np.empty((BITS, len(grams)), dtype=bool)
    for b in range(BITS):
        value = known = None
        for d in range(depth, shallow - 1, -1):
            level, at = levels[d], index[d]
            kt, here = level.kt(b)[at], (level.n[b] > 0)[level.node[b]][at]
            if value is None:
                value, known = kt, here
                continue
            w = level.own_weight(b)[at]
            value = np.where(known, w * kt + (1 - w) * value, kt)
            known = here
        q[b], seen[b] = value, known
    return q, seen


def shallow_maps(counts1: np.ndarray, below: np.ndarray):
    """Affine maps from the depth-2 estimate to the root's: ``q_0 = add + times * q_2`` for seen depth-2 nodes.

    ``counts1``: (256, 256) training counts of (previous byte, symbol). ``below``: (256, 8, 256) sums of the
    depth-2 nodes' log Pw by (previous byte, bit, leading bits). Returns (add, times, own): arrays of shape
    (256, 256, 8); ``own`` is the estimate where the depth-2 node was never seen."""
    symbols = np.arange(256)
    pe1 = np.zeros((256, 8, 256))
    n1, ones1 = np.zeros((256, 8, 256)), np.zeros((256, 8, 256))
    for b in range(BITS):
        prefix, bit = symbols >> (8 - b), (symbols >> (7 - b)) & 1
        for ctx in range(256):
            n1[ctx, b] = np.bincount(prefix, weights=counts1[ctx], minlength=256)
            ones1[ctx, b] = np.bincount(prefix, weights=counts1[ctx] * bit, minlength=256)
    pe1 = log_kt(n1 - ones1, ones1)
    pw1 = np.where(n1 > 0, np.logaddexp(pe1, below) - LN2, 0.0)
    n0, ones0 = n1.sum(0), ones1.sum(0)
    pe0 = log_kt(n0 - ones0, ones0)
    pw0 = np.where(n0 > 0, np.logaddexp(pe0, pw1.sum(0)) - LN2, 0.0)
    w1 = np.where(n1 > 0, np.exp(np.minimum(pe1 - LN2 - pw1, 0.0)), 1.0)
    w0 = np.where(n0 > 0, np.exp(np.minimum(pe0 - LN2 - pw0, 0.0)), 1.0)
    add, times, own = (np.empty((256, 256, 8)) for _ in range(3))
    for b in range(BITS):
        prefix, bit = symbols >> (8 - b), (symbols >> (7 - b)) & 1
        kt1 = (np.where(bit == 1, ones1[:, b, :][:, prefix], (n1 - ones1)[:, b, :][:, prefix]) + 0.5) / (n1[:, b, :][:, prefix] + 1)
        kt0 = (np.where(bit == 1, ones0[b, prefix], (n0 - ones0)[b, prefix]) + 0.5) / (n0[b, prefix] + 1)
        seen1, w0b, w1b = n1[:, b, :][:, prefix] > 0, w0[b, prefix], w1[:, b, :][:, prefix]
        root = lambda q1: w0b * kt0 + (1 - w0b) * np.where(seen1, q1, kt0)  # noqa: B023,E731
        add[:, :, b] = root(w1b * kt1)
        times[:, :, b] = np.where(seen1, (1 - w0b) * (1 - w1b), 0.0)
        own[:, :, b] = root(kt1)
    return add, times, own


def log10_probability(grams: np.ndarray, q: np.ndarray, seen: np.ndarray, maps) -> np.ndarray:
    """log10 probability of each gram's symbol given its context, over all depths."""
    add, times, own = maps
    shift = np.uint64(8 * DEPTH)
    ctx, symbol = (grams >> shift).astype(np.int64), (grams & np.uint64(255)).astype(np.int64)
    out = np.zeros(len(grams))
    for b in range(BITS):
        value = np.where(seen[b], add[ctx, symbol, b] + times[ctx, symbol, b] * q[b], own[ctx, symbol, b])
        out += np.log10(value)
    return out


def pack(stream: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """The gram of every byte of ``stream`` (one uint64 a byte); the caller drops the padding's positions."""
    n = len(stream)
    cells = np.zeros((n, 8), dtype=np.uint8)  # little endian: column 0 is the lowest byte
    cells[:, 0] = stream
    for d in range(1, depth + 1):
        cells[d:, depth + 1 - d] = stream[:n - d]
    return cells.view("<u8").reshape(-1)
