"""Operator 8: embedding near-dedup with hierarchical navigable small-world graphs.

Exact copies (same label, same numbers) are one class. Classes of a label are dealt by hash into shards of at
most about ``SHARD`` vectors or ``SHARD_BYTES``, so a hot label has many shards; every shard gets its own graph, and every class
queries every shard of its label, in chunks of ``CHUNK`` queries. A chunk's beams are widened until its audit
queries (``AUDIT`` of them, compared with the whole shard by brute force) reach the asked recall, both of their
links and of their ``NEAR`` nearest neighbours in the shard, which there always are; a query whose whole beam
links is repeated with a wider one, so large groups are found whole, and the repeated queries are audited by
their links at each beam, which widens on a miss (a beam that would take a good part of the shard is widened to
all of it, by products instead of a walk). Found pairs are verified by cosine in double precision. A chunk returns each query's number of linked vectors and, instead of pairs, one
edge per vector to a smaller linked one per chunk-local component; components are then joined.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite numbers, and vectors with a null
label, link with nothing; vectors of different lengths are never compared; copies of a row are vectors of
their own that link with each other; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlens.llm.common import components, written
from termlens.llm.hnsw import Graph

SHARD, SHARD_BYTES = 16384, 32 << 20  # vectors a shard, and bytes of them: a shard is one packed row
CHUNK = 1024
AUDIT = 48
NEAR = 10  # nearest neighbours an audit query is measured by
RECALL = 0.99
BEAM = 48
WIDE = 32  # a beam of 1 / WIDE of the shard or more is widened to the whole shard


def _unit(arrays) -> np.ndarray:
    x = np.array([np.asarray(a, dtype=np.float64) for a in arrays])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _found(graph: Graph, unit: np.ndarray, queries: np.ndarray, threshold: float, beam: int, extra: int):
    """Verified (query row, shard row) pairs; queries whose beam was full of links."""
    q, n, full = [], [], []
    for lo in range(0, len(queries), 256):
        part = queries[lo:lo + 256]
        ids, sims = graph.search(part.astype(np.float32), beam, extra)
        r, c = np.nonzero((ids >= 0) & (sims >= threshold - 1e-3))
        node = ids[r, c]
        keep = np.einsum("id,id->i", part[r], unit[node]) >= threshold
        q.append(r[keep] + lo)
        n.append(node[keep])
        full.append(np.flatnonzero((sims >= threshold - 1e-3).all(1) & (ids >= 0).all(1)) + lo)
    return np.concatenate(q), np.concatenate(n), np.concatenate(full)


def _all(unit: np.ndarray, queries: np.ndarray, threshold: float):
    """Verified pairs of the queries with the whole shard: the widest beam, without a walk."""
    q, n = [], []
    for lo in range(0, len(queries), 256):
        part = queries[lo:lo + 256]
        r, node = np.nonzero(part @ unit.T >= threshold - 1e-9)
        keep = np.einsum("id,id->i", part[r], unit[node]) >= threshold
        q.append(r[keep] + lo)
        n.append(node[keep])
    return np.concatenate(q), np.concatenate(n)


def _near(found: np.ndarray, sims: np.ndarray, own: np.ndarray):
    """How many of the ``NEAR`` nearest of each query, by all its similarities ``sims`` and itself left out, are
    among the ids ``found``, and how many there are."""
    rows = np.arange(len(sims))
    among = np.zeros(sims.shape, dtype=bool)
    r, c = np.nonzero(found >= 0)
    among[r, found[r, c]] = True
    sims, itself = sims.copy(), own >= 0
    sims[rows[itself], own[itself]] = -2.0
    k = np.minimum(NEAR, sims.shape[1] - itself)
    least = -np.sort(-sims, axis=1)[rows, np.maximum(k, 1) - 1]  # ties of the last one count as it does
    return np.minimum((among & (sims >= least[:, None] - 1e-6) & (sims > -1.5)).sum(1), k), k


def search_shard(graph: Graph, unit: np.ndarray, queries: np.ndarray, threshold: float, own: np.ndarray | None = None):
    """All links of ``queries`` into one shard: (query row, shard row). Beams widen until the audits pass.
    ``own`` is the shard row that each query is itself, -1: none (the default)."""
    if not len(unit) or not len(queries):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    audit = np.unique(np.linspace(0, len(queries) - 1, min(AUDIT, len(queries))).astype(int))
    sims = queries[audit] @ unit.T
    truth = (sims >= threshold).sum(1)
    itself = np.full(len(audit), -1) if own is None else own[audit]
    beam, extra = min(BEAM, len(unit)), 0
    while True:
        q, _, full = _found(graph, unit, queries[audit], threshold, beam, extra)
        # a query with a full beam gets a wider one of its own below: it says nothing of the others' links
        linked = np.count_nonzero(~np.isin(q, full)) >= RECALL * np.delete(truth, full).sum()
        hits, near = _near(graph.search(queries[audit].astype(np.float32), beam, extra)[0], sims, itself)
        if (linked and hits.sum() >= RECALL * near.sum()) or beam >= len(unit):
            break
        beam, extra = min(2 * beam, len(unit)), max(8, 2 * extra)
        if beam * WIDE >= len(unit):
            return _all(unit, queries, threshold)
    q, n, full = _found(graph, unit, queries, threshold, beam, extra)
    while len(full) and beam < len(unit):
        beam = min(4 * beam, len(unit))
        keep = ~np.isin(q, full)
        if beam * WIDE >= len(unit):
            q2, n2 = _all(unit, queries[full], threshold)
            still = np.zeros(0, dtype=np.int64)
        else:
            q2, n2, still = _found(graph, unit, queries[full], threshold, beam, extra)
            done = np.setdiff1d(np.arange(len(full)), still)  # these would stay as they are: audited at this beam
            done = done[np.unique(np.linspace(0, len(done) - 1, min(AUDIT, len(done))).astype(int))]
            if np.isin(q2, done).sum() < RECALL * (queries[full[done]] @ unit.T >= threshold).sum():
                still = np.arange(len(full))
        q, n, full = np.append(q[keep], full[q2]), np.append(n[keep], n2), full[still]
    return q, n


def _local_edges(a: np.ndarray, b: np.ndarray):
    """The smallest key of each key's component over pairs (a, b): (key, smallest)."""
    keys, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at.reshape(2, -1)
    low = np.arange(len(keys))
    while True:
        new = low.copy()
        np.minimum.at(new, x, low[y])
        np.minimum.at(new, y, low[x])
        new = new[new]
        if (new == low).all():
            return keys, keys[low]
        low = new


def _search(threshold: float):
    def run(shard: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(shard) or not len(queries):
            return pd.DataFrame({"class": [], "low": [], "links": []})
        packed = shard.iloc[0]
        keys, counts = np.frombuffer(packed["keys"], np.int64), np.frombuffer(packed["counts"], np.int64)
        unit, asked, own = np.frombuffer(packed["vectors"], np.float64).reshape(len(keys), -1), _unit(queries.v), queries["class"].to_numpy()
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)  # keys are sorted
        q, n = search_shard(Graph.restored(unit, packed["links"]), unit, asked, threshold, np.where(keys[at] == own, at, -1))
        other = keys[n] != own[q]
        q, n = q[other], n[other]
        links = np.bincount(q, weights=counts[n], minlength=len(own)).astype(np.int64)
        key, low = _local_edges(own[q], keys[n])
        return pd.concat([pd.DataFrame({"class": own, "low": own, "links": links}), pd.DataFrame({"class": key, "low": low, "links": 0})[lambda f: f["class"] != f["low"]]])
    return run


def near_duplicates(rows: DataFrame, id_col: str, vector_col: str, label_col: str, threshold: float = 0.98) -> DataFrame:
    """(id, n_links, component_id, kept) for each row of ``rows``."""
    v = F.col("v")
    good = (F.coalesce(F.size(v), F.lit(0)) > 0) & F.col("label").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) \
        & F.exists(v, lambda x: x != 0)
    base = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.transform(vector_col, lambda x: x.cast("double") + 0.0).alias("v"))
    base = base.withColumn("class", F.when(good, F.xxhash64("label", "v")))
    members = base.select("id", "class")
    classes = written(base.where(good).groupBy("class").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("n"), F.min("id").alias("least"))
                      .withColumn("dim", F.size("v")), "hnsw-classes")
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("m")).withColumn("shards", F.ceil(F.col("m") / F.greatest(F.lit(1), F.least(F.lit(SHARD), F.floor(F.lit(SHARD_BYTES) / (8 * F.col("dim"))))))).withColumn("chunks", F.ceil(F.col("m") / CHUNK)).drop("m")
    placed = classes.join(sizes, ["label", "dim"])
    placed = placed.withColumn("shard", F.pmod(F.xxhash64("class", F.lit(1)), F.col("shards"))).withColumn("chunk", F.pmod(F.xxhash64("class", F.lit(2)), F.col("chunks")))

    def build(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("class")
        unit = _unit(part.v)
        return pd.DataFrame([{"label": key[0], "dim": key[1], "shard": key[2], "chunks": part.chunks.iloc[0], "keys": part["class"].to_numpy(np.int64).tobytes(),
                              "vectors": unit.tobytes(), "counts": part.n.to_numpy(np.int64).tobytes(), "links": Graph(unit).packed()}])

    kind = f"label {base.schema['label'].dataType.simpleString()}, dim int, shard long, chunks long, keys binary, vectors binary, counts binary, links binary"
    graphs = written(placed.select("class", "label", "dim", "v", "n", "shard", "chunks").groupBy("label", "dim", "shard").applyInPandas(build, kind), "hnsw-graphs")
    each = graphs.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    asked = placed.select("class", "label", "dim", "v", "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"))
    keys = ["label", "dim", "shard", "chunk"]
    found = written(each.groupBy(keys).cogroup(asked.groupBy(keys)).applyInPandas(_search(threshold), "class long, low long, links long"), "hnsw-found")
    joined = components(found.where(F.col("class") != F.col("low")).select(F.col("class").alias("a"), F.col("low").alias("b")))
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    named = (classes.select("class", "n", "least").join(links, "class", "left")
             .join(joined.select(F.col("node").alias("class"), "component"), "class", "left").withColumn("component", F.coalesce("component", "class")))
    lowest = named.groupBy("component").agg(F.min("least").alias("low"))
    named = named.join(lowest, "component").select("class", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "low")
    return (members.join(named, "class", "left")
            .select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("low", "id").alias("component_id"))
            .withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))))
