"""Hierarchical navigable small-world graph in numpy: many queries walk the graph at once.

Used inside Spark tasks, one graph per shard of bounded size. Similarity is the dot product of unit vectors."""

from __future__ import annotations

import numpy as np

from termlens.llm.common import mixed

M = 12  # links a node chooses; the bottom layer keeps up to 2 M
BUILD_BEAM = 64
BATCH = 256
EXPAND = 4  # nodes a query expands a step


class Graph:
    """Layers from the bottom up: ``nodes`` (ids in insertion order) and ``links`` (rows of ids, -1: none)."""

    def __init__(self, vectors: np.ndarray, seed: int = 1):
        self.x = np.ascontiguousarray(vectors, dtype=np.float32)
        n = len(self.x)
        u = (mixed(np.arange(n, dtype=np.uint64) + (np.uint64(seed) << np.uint64(40))) >> np.uint64(11)).astype(float) / 2.0**53
        self.level = np.minimum((-np.log(np.maximum(u, 1e-12)) / np.log(M)).astype(int), 8)
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []
        entry = None
        for depth in range(int(self.level.max()) if n else -1, -1, -1):
            nodes = np.flatnonzero(self.level >= depth)
            nodes = nodes[np.argsort(-self.level[nodes], kind="stable")]  # nodes of the layer above come first
            links = np.full((n, 2 * M), -1, dtype=np.int32)
            self._build(nodes, links)
            self.layers.insert(0, (nodes, links))
            entry = nodes[0]
        self.entry = entry

    def packed(self) -> bytes:
        """Levels of all vectors, then layer by layer the links of the vectors that belong to it."""
        return b"".join([self.level.astype(np.int32).tobytes(), *[links[self.level >= depth].tobytes() for depth, (_, links) in enumerate(self.layers)]])

    @classmethod
    def restored(cls, vectors: np.ndarray, packed: bytes) -> "Graph":
        """The graph of the same vectors in the same order, from ``packed()``."""
        graph, flat, n = cls.__new__(cls), np.frombuffer(packed, np.int32), len(vectors)
        graph.x = np.ascontiguousarray(vectors, dtype=np.float32)
        graph.level, at = flat[:n].astype(int), n
        graph.layers = []
        for depth in range(int(graph.level.max()) + 1 if n else 0):
            nodes = np.flatnonzero(graph.level >= depth)
            links = np.full((n, 2 * M), -1, dtype=np.int32)
            links[nodes] = flat[at:at + len(nodes) * 2 * M].reshape(-1, 2 * M)
            at += len(nodes) * 2 * M
            graph.layers.append((nodes[np.argsort(-graph.level[nodes], kind="stable")], links))
        graph.entry = graph.layers[-1][0][0] if graph.layers else None
        return graph

    def _build(self, nodes: np.ndarray, links: np.ndarray) -> None:
        first = nodes[:BATCH]
        if len(first) > 1:
            near = self.x[first] @ self.x[first].T
            np.fill_diagonal(near, -2)
            order = np.argsort(-near, axis=1)[:, :min(BUILD_BEAM, len(first) - 1)]
            self._connect(first, first[order], np.take_along_axis(near, order, 1), links)
        for lo in range(BATCH, len(nodes), BATCH):
            new, old = nodes[lo:lo + BATCH], nodes[:lo]
            starts = np.broadcast_to(old[np.linspace(0, len(old) - 1, 8).astype(int)], (len(new), 8))
            ids, sims = self._walk(self.x[new], links, starts, BUILD_BEAM)
            among = self.x[new] @ self.x[new].T
            np.fill_diagonal(among, -2)
            ids = np.hstack([ids, np.broadcast_to(new, (len(new), len(new)))])
            sims = np.hstack([sims, among])
            order = np.argsort(-sims, axis=1)[:, :BUILD_BEAM]
            self._connect(new, np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1), links)

    def _spread(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of candidates sorted by similarity, those nearer to the node than to any chosen before, then the
        nearest others; rows of ``most`` ids, -1: none."""
        vectors = self.x[np.maximum(ids, 0)]
        between = vectors @ vectors.transpose(0, 2, 1)
        valid = (ids >= 0) & (sims > -1.5)
        chosen = np.zeros(ids.shape, dtype=bool)
        closest = np.full(ids.shape, -2.0, dtype=np.float32)  # similarity to the nearest chosen one
        taken = np.zeros(len(ids), dtype=np.int64)
        for c in range(ids.shape[1]):
            r = np.flatnonzero(valid[:, c] & (sims[:, c] > closest[:, c]) & (taken < max(1, most // 2)))
            if len(r):
                chosen[r, c] = True
                taken[r] += 1
                closest[r] = np.maximum(closest[r], between[r, c])
        rank = np.argsort(np.where(chosen, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :most]
        out = np.where(np.take_along_axis(valid, rank, 1), np.take_along_axis(ids, rank, 1), -1)
        return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)

    def _connect(self, new: np.ndarray, ids: np.ndarray, sims: np.ndarray, links: np.ndarray) -> None:
        links[new, :M] = self._spread(ids, sims, M)
        source = np.repeat(new, M)
        target = links[new, :M].reshape(-1)
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        at, counts = np.unique(target, return_counts=True)
        ends = np.cumsum(counts)
        for lo in range(0, len(at), BATCH):  # back links: merge, and thin out where there are too many
            part = at[lo:lo + BATCH]
            count, end = counts[lo:lo + BATCH], ends[lo:lo + BATCH]
            fresh = np.full((len(part), int(count.max())), -1, dtype=np.int64)
            first = end[0] - count[0]
            row = np.repeat(np.arange(len(part)), count)
            fresh[row, np.arange(first, end[-1]) - (end - count)[row]] = source[first:end[-1]]
            every = np.hstack([links[part], fresh])
            sims = (self.x[np.maximum(every, 0)] @ self.x[part][:, :, None])[:, :, 0]
            again = (every[:, :, None] == every[:, None, :]) & (np.arange(every.shape[1])[None, :, None] > np.arange(every.shape[1])[None, None, :])
            sims = np.where((every < 0) | again.any(2), -2.0, sims)
            order = np.argsort(-sims, axis=1, kind="stable")
            every, sims = np.take_along_axis(every, order, 1), np.take_along_axis(sims, order, 1)
            every = np.where(sims > -1.5, every, -1)
            full = (every[:, 2 * M:] >= 0).any(1) if every.shape[1] > 2 * M else np.zeros(len(part), dtype=bool)
            rows = every[:, :2 * M].astype(np.int32)
            rows = np.pad(rows, ((0, 0), (0, 2 * M - rows.shape[1])), constant_values=-1)
            if full.any():
                rows[full] = self._spread(every[full][:, :96], sims[full][:, :96], 2 * M)
            links[part] = rows

    def _walk(self, q: np.ndarray, links: np.ndarray, starts: np.ndarray, beam: int):
        """Beam search of all rows of ``q`` in one layer: (ids, similarities), best first, -1: none."""
        rows = np.arange(len(q))[:, None]
        seen = np.zeros((len(q), len(self.x)), dtype=bool)
        starts = np.sort(starts, axis=1)
        fresh = np.concatenate([np.ones((len(q), 1), bool), starts[:, 1:] != starts[:, :-1]], axis=1) & (starts >= 0)
        ids = np.where(fresh, starts, -1)
        sims = np.where(fresh, np.einsum("qd,qcd->qc", q, self.x[np.maximum(ids, 0)]), -2.0)
        seen[np.broadcast_to(rows, ids.shape)[fresh], ids[fresh]] = True
        width = max(beam, ids.shape[1])
        ids = np.pad(ids, ((0, 0), (0, width - ids.shape[1])), constant_values=-1)
        sims = np.pad(sims, ((0, 0), (0, width - sims.shape[1])), constant_values=-2.0)
        order = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        best_ids, best_sims = ids, sims  # what is known of all queries; below, of those that still walk
        open_ = ids >= 0
        live = np.arange(len(q))
        while len(live):
            rank = np.where(open_, np.arange(beam), beam * 2)
            step = np.argpartition(rank, min(EXPAND, beam) - 1, axis=1)[:, :EXPAND] if beam > EXPAND else np.broadcast_to(np.arange(beam), (len(live), beam))
            usable = np.take_along_axis(open_, step, 1)
            at = np.take_along_axis(ids, step, 1)
            np.put_along_axis(open_, step, False, 1)
            near = np.where(usable[:, :, None], links[np.maximum(at, 0)], -1).reshape(len(live), -1)
            near = np.sort(near, axis=1)
            fresh = (near >= 0) & np.concatenate([np.ones((len(live), 1), bool), near[:, 1:] != near[:, :-1]], axis=1)
            fresh &= ~seen[live[:, None], np.maximum(near, 0)]
            r, c = np.nonzero(fresh)
            if len(r):  # only the new candidates, side by side, go into the beams
                new, place = near[r, c], (np.cumsum(fresh, axis=1) - 1)[r, c]
                seen[live[r], new] = True
                got = np.full((len(live), int(place.max()) + 1), -2.0, dtype=np.float32)
                got[r, place] = np.einsum("id,id->i", q[live[r]], self.x[new])
                named = np.full(got.shape, -1, dtype=ids.dtype)
                named[r, place] = new
                every = np.hstack([sims, got])
                order = np.argsort(-every, axis=1, kind="stable")[:, :beam]
                sims = np.take_along_axis(every, order, 1)
                ids = np.take_along_axis(np.hstack([ids, named]), order, 1)
                open_ = np.take_along_axis(np.hstack([open_, named >= 0]), order, 1)
            going = open_.any(1)
            if not going.all():
                best_ids[live[~going]], best_sims[live[~going]] = ids[~going], sims[~going]
                live, ids, sims, open_ = live[going], ids[going], sims[going], open_[going]
        ids, sims = best_ids, best_sims
        return ids, sims

    def search(self, q: np.ndarray, beam: int, extra: int = 0):
        """(ids, similarities) of the ``beam`` best found for each row of ``q``; ``extra`` further entry points."""
        if not len(self.x):
            return np.full((len(q), 0), -1), np.zeros((len(q), 0))
        starts = np.full((len(q), 1), self.entry)
        for _, links in reversed(self.layers[1:]):
            found, _ = self._walk(q, links, starts, 4)
            starts = found
        if extra:
            more = np.linspace(0, len(self.x) - 1, extra).astype(int)
            starts = np.hstack([starts, np.broadcast_to(more, (len(q), extra))])
        return self._walk(q, self.layers[0][1], starts, max(beam, starts.shape[1]))
