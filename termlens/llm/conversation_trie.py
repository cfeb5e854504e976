"""Operator 12: prefix trie of conversations, from padded matrices of turn ids in range shards.

Every distinct sequence of first ``d`` turns (role, text) is a node of depth ``d``; the conversations that start with it
are its members. A turn's id is 128 bits of a digest of role and text.

Conversations are cut into blocks of 64 turns, so a row is small however long its conversation is. Block rows are dealt
out by ranges of (block, what lies ahead of it, first eight ids, digest of all ids, conversation), so equal prefixes lie
together and a hot prefix or a hot conversation still spreads over shards. A shard pads its rows' ids into a matrix
of dense codes and sorts it by ``numpy.lexsort``. Column-wise changes between neighbouring rows, OR-accumulated along
the columns, mark where a node of each depth starts, and ``reduceat`` over these starts aggregates every depth. Nodes on
the path of a shard's first or last row may go on in the next shard; only those recombine, in small grouped sums.

Two passes make the subtree figures plain sums over members, so no pass climbs the trie. A conversation owns the nodes
of which it is the smallest member; members get fewer with depth, so it owns its path from some depth on. Pass 1 finds
that depth, the bytes ahead of it, the smallest member of the node above it, and whether the conversation owns a
childless end. With these, in pass 2, children are members that own the next turn, leaves are members that own a childless
end, and saved bytes are the members' unowned bytes from the node's last turn on.

Digests of the conversations that end at a node are taken over their ids in order: inside a shard at once, for shared nodes
over pieces of joined ids that stream through one hash in the order of their ranges.

Defined cases: turns are ordered by turn (null first), then role, then md5 of the text; null role or text is empty;
repeated turns count each; rows without a conversation id belong to none; an empty table gives no rows (no root);
other columns are not carried.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termlens.llm.common import numbered, written

BLOCK = 64
LEAD = 8  # ids of a row that take part in the range key
SHARD = 1 << 17  # turns of a shard
PIECE = 1 << 15  # letters of a piece of joined ids
EMPTY = hashlib.sha256(b"").hexdigest()


# ---- sequences ------------------------------------------------------------------------------------------

def ordered(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, before, h, n): every turn with its 0-based place in its conversation, its digest and its text's bytes."""
    r, x = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    said = df.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).isNotNull().alias("timed"), F.col(turn).alias("t"), r.alias("r"), F.md5(x).alias("x"),
        F.md5(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, x)).alias("h"), F.octet_length(x).cast("long").alias("n"))
    return numbered(said, ["conv"], ["timed", "t", "r", "x"], name="trie-turns").select("conv", "before", "h", "n")


def branched(turns: DataFrame, root, take, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt from another one's head: the first ``take`` turns of conversation ``root``, then their own
    turns after the first ``take``. Both are columns over ``conv``; ``take`` is at most ``most``.
    Gives (conversations: conv) and (turns: conv, depth, h, n)."""
    heads = turns.where(F.col("before") < most).groupBy(F.col("conv").alias("head")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("before", "h", "n"))), lambda e: F.struct(e.h.alias("h"), e.n.alias("n"))).alias("a"))
    convs = turns.select("conv").distinct()
    lead = convs.join(heads, root == F.col("head"), "left").select(
        "conv", F.when(F.col("a").isNotNull(), F.slice("a", 1, take.cast("int"))).alias("a"))
    front = lead.select("conv", F.posexplode("a").alias("p", "e")).select("conv", (F.col("p") + 1).cast("long").alias("depth"), "e.h", "e.n")
    sizes = lead.select("conv", F.coalesce(F.size("a"), F.lit(0)).alias("lead"))
    rest = turns.where(F.col("before") >= take).join(sizes, "conv").select(
        "conv", (F.col("lead") + F.col("before") - take + 1).cast("long").alias("depth"), "h", "n")
    return convs, front.unionByName(rest)


def _blocks(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv, block, ids, ns, lead, rest, length, total, w, b0..b3): a row per conversation and block of turns, with the
    conversation's length and bytes, and the bytes and the sums of ids ahead of the block."""
    placed = turns.withColumn("id", F.md5(F.concat(F.col("h"), F.lit(":"), F.col("depth").cast("string")))).withColumn(
        "block", F.floor((F.col("depth") - 1) / BLOCK))
    quarter = lambda k: F.conv(F.substring("id", 8 * k + 1, 8), 16, 10).cast("long")
    rows = placed.groupBy("conv", "block").agg(
        F.sort_array(F.collect_list(F.struct("depth", "id", "n"))).alias("a"), F.count("*").alias("s_k"), F.sum("n").alias("s_w"),
        *[F.sum(quarter(k)).alias(f"s_b{k}") for k in range(4)])
    hexes = F.transform("a", lambda e: e.id)
    rows = rows.select(
        "conv", "block", F.array_join(hexes, "").alias("hex"), F.transform("a", lambda e: e.n).alias("ns"),
        F.array_join(F.transform(F.slice(hexes, 1, LEAD), lambda x: F.substring(x, 1, 16)), "").alias("lead"),
        F.floor(F.col("block") / 1024).alias("super"), *[c for c in rows.columns if c.startswith("s_")])
    rows = written(rows.withColumn("rest", F.md5("hex")).withColumn("ids", F.unhex("hex")).drop("hex"), "trie-blocks")
    # what lies ahead of a block, in two levels: over a conversation's thousands of blocks, then inside each thousand
    sums = ["k", "w", "b0", "b1", "b2", "b3"]
    upper = rows.groupBy("conv", "super").agg(*[F.sum(f"s_{c}").alias(f"u_{c}") for c in sums])
    by_conv = Window.partitionBy("conv")
    earlier = by_conv.orderBy("super").rowsBetween(Window.unboundedPreceding, -1)
    upper = upper.select("conv", "super", F.sum("u_k").over(by_conv).alias("length"), F.sum("u_w").over(by_conv).alias("total"),
                         *[F.coalesce(F.sum(f"u_{c}").over(earlier), F.lit(0)).alias(f"o_{c}") for c in sums[1:]])
    inner = Window.partitionBy("conv", "super").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(upper, ["conv", "super"]).select(
        "conv", "block", "ids", "ns", "lead", "rest", "length", "total",
        *[(F.col(f"o_{c}") + F.coalesce(F.sum(f"s_{c}").over(inner), F.lit(0))).alias(c) for c in sums[1:]])
    none = convs.join(turns.select("conv").distinct(), "conv", "left_anti")
    zero = F.lit(0).cast("long")
    none = none.select("conv", zero.alias("block"), F.lit(b"").alias("ids"), F.array().cast("array<long>").alias("ns"), F.lit("").alias("lead"),
                       F.md5(F.lit("")).alias("rest"), zero.alias("length"), zero.alias("total"), *[zero.alias(c) for c in sums[1:]])
    return rows.unionByName(none)


# ---- one shard ----------------------------------------------------------------------------------------------

def _codes(*columns: np.ndarray) -> np.ndarray:
    """Dense codes from 1 of the rows of equally long columns, in their order."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), dtype=np.int32)
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), dtype=np.int32)
    out[order] = np.cumsum(new) + 1
    return out


class _Shard:
    """The sorted padded matrix of a shard's block rows and the change masks that mark node starts."""

    def __init__(self, table: pa.Table):
        col = lambda c: table.column(c).to_numpy()
        conv, block = col("conv"), col("block")
        b = np.stack([col(f"b{k}") for k in range(4)], axis=1)
        raw = table.column("ids").to_pylist()
        sizes = np.array([len(x) // 16 for x in raw], dtype=np.int64)
        flat = np.frombuffer(b"".join(raw), dtype=">u8").reshape(-1, 2).astype(np.uint64)
        quads = np.frombuffer(b"".join(raw), dtype=">u4").reshape(-1, 4).astype(np.int64)
        self.id_sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(quads, axis=0)])
        ns = np.concatenate([np.asarray(c.flatten()) for c in table.column("ns").chunks]) if len(flat) else np.zeros(0, np.int64)
        self.byte_sums = np.append(0, np.cumsum(ns))
        off = np.cumsum(sizes) - sizes
        width = int(sizes.max())
        matrix = np.zeros((len(conv), width), dtype=np.int32)  # padded with 0, so the shorter sort first
        if width:
            matrix[np.arange(width) < sizes[:, None]] = _codes(flat[:, 0], flat[:, 1])
        group = _codes(block, *b.T)
        order = np.lexsort((conv, *(matrix[:, j] for j in range(width - 1, -1, -1)), group))
        self.matrix, group = matrix[order], group[order]
        self.conv, self.block, self.b, self.off = conv[order], block[order], b[order], off[order]
        self.w, self.length, self.order, self.width = col("w")[order], col("length")[order], order, width
        change = np.ones((len(conv), width), dtype=bool)
        change[1:] = self.matrix[1:] != self.matrix[:-1]
        if width:
            change[1:, 0] |= group[1:] != group[:-1]
            np.logical_or.accumulate(change, axis=1, out=change)
        self.change = change
        self.upto = self._shared(block, b[:, 0], table.column("lead").to_pylist())[order]

    def _shared(self, block, ahead, lead) -> np.ndarray:
        """Per row: its nodes up to this column lie on the path of the shard's first or last row, by the range key, and
        may have members elsewhere."""
        units = np.array(lead, dtype=f"S{16 * LEAD}").view("S16").reshape(len(lead), LEAD)
        out = np.zeros(len(lead), dtype=np.int64)
        for pick in (min, max):
            rows = np.flatnonzero(block == pick(block.min(), block.max()))
            rows = rows[ahead[rows] == pick(ahead[rows].min(), ahead[rows].max())]
            edge = pick(lead[i] for i in rows)
            same = units[rows] == np.array([edge], dtype=f"S{16 * LEAD}").view("S16")
            common = np.logical_and.accumulate(same, axis=1).sum(axis=1)
            out[rows] = np.maximum(out[rows], np.where(common == LEAD, BLOCK, common))
        return out

    def key(self, rows: np.ndarray, j: int) -> list[bytes]:
        """What stands for the first ``j`` turns of the rows' blocks and all ahead of them."""
        data = (self.b[rows] + self.id_sums[self.off[rows] + j] - self.id_sums[self.off[rows]]).astype(">i8").tobytes()
        return [data[i:i + 32] for i in range(0, len(data), 32)]

    def bytes_to(self, rows: np.ndarray, j: int) -> np.ndarray:
        """Bytes of all turns ahead of the block and its first ``j``."""
        return self.w[rows] + self.byte_sums[self.off[rows] + j] - self.byte_sums[self.off[rows]]

    def levels(self):
        """(j, members' rows, starts among them, depth, shared) for the root (j = -1) and every column."""
        rows = np.flatnonzero(self.block == 0)
        if len(rows):
            yield -1, rows, np.zeros(1, dtype=np.int64), np.zeros(len(rows), np.int64), np.ones(len(rows), bool)
        for j in range(self.width):
            rows = np.flatnonzero(self.matrix[:, j])
            yield j, rows, np.flatnonzero(self.change[rows, j]), self.block[rows] * BLOCK + j + 1, j < self.upto[rows]


def _spread(starts: np.ndarray, n: int) -> np.ndarray:
    """Number of the segment each of ``n`` rows is in."""
    flags = np.zeros(n, dtype=np.int64)
    flags[starts[1:]] = 1
    return np.cumsum(flags)


def _opt(values: np.ndarray, known: np.ndarray) -> pa.Array:
    return pa.array(values, mask=~known)


OWN = "kind int, conv long, depth long, bytes long, n long, e long, leaf boolean, up long, key binary, above binary"
SHARED_NODE, OWNED, BLOCK_END = 0, 1, 2


def _own(batches):
    """Pass 1: shared nodes in part, and per row the first inner node it owns; the inner nodes at block ends."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    s = _Shard(pa.Table.from_batches(batches))
    n = len(s.conv)
    first, leaf = np.full(n, -1, np.int64), np.zeros(n, bool)
    depth_of, bytes_of, up, up_known = (np.zeros(n, np.int64) for _ in range(4))
    above_min, above_inner = np.zeros(n, np.int64), np.zeros(n, bool)
    out = []

    def put(kind, conv, depth, size, members, ends, leaves, ups, key, above):
        k = len(conv)
        none = pa.nulls(k, pa.binary())
        out.append(pa.RecordBatch.from_arrays(
            [pa.array(np.full(k, kind, np.int32)), pa.array(conv), pa.array(depth), pa.array(size), pa.array(members), pa.array(ends), pa.array(leaves), ups,
             none if key is None else pa.array(key, pa.binary()), none if above is None else pa.array(above, pa.binary())],
            names=["kind", "conv", "depth", "bytes", "n", "e", "leaf", "up", "key", "above"]))

    for j, rows, starts, depth, shared in s.levels():
        if not len(rows):
            continue
        seg = _spread(starts, len(rows))
        least = np.minimum.reduceat(s.conv[rows], starts)
        ends = s.length[rows] == depth
        e = np.add.reduceat(ends.astype(np.int64), starts)
        members = np.diff(np.append(starts, len(rows)))
        head = rows[starts]
        at, part = max(j, 0), shared[starts]
        if part.any():
            h = head[part]
            k = np.zeros(len(h), bool)
            put(SHARED_NODE, least[part], depth[starts][part], s.bytes_to(h, at), members[part], e[part], k, pa.nulls(len(h), pa.int64()),
                s.key(h, j + 1), s.key(h, at))
        mine = (s.conv[rows] == least[seg]) & ~shared
        new = rows[mine & (first[rows] < 0)]
        first[new], depth_of[new], bytes_of[new] = j, s.block[new] * BLOCK + j + 1, s.bytes_to(new, at)
        up[new], up_known[new] = above_min[new], above_inner[new]
        leaf[rows[mine & ends & (members == e)[seg]]] = True
        if j == BLOCK - 1:
            on = ~part & (members > e)
            h = head[on]
            put(BLOCK_END, least[on], depth[starts][on], np.zeros(len(h), np.int64), members[on], e[on], np.zeros(len(h), bool),
                pa.nulls(len(h), pa.int64()), s.key(h, BLOCK), None)
        if j >= 0:
            above_min[rows], above_inner[rows] = least[seg], ~shared
    for j in np.unique(first[first >= 0]):
        rows = np.flatnonzero(first == j)
        zero = np.zeros(len(rows), np.int64)
        put(OWNED, s.conv[rows], depth_of[rows], bytes_of[rows], zero, zero, leaf[rows], _opt(up[rows], up_known[rows].astype(bool)), None, s.key(rows, int(j)))
    yield from out


NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
        "key binary, first long, piece string")


def _nodes(batches):
    """Pass 2: inner nodes whole, shared ones in part (with a key), and pieces of the ids that end at a shared one."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    s = _Shard(table)
    col = lambda c: table.column(c).to_numpy()[s.order]
    owned, ahead, leaf = col("own_depth"), col("own_bytes"), col("leaf").astype(np.int64)
    up = table.column("up").fill_null(0).to_numpy()[s.order]
    up_known = table.column("up").is_valid().to_numpy()[s.order]
    for j, rows, starts, depth, shared in s.levels():
        if not len(rows):
            continue
        seg = _spread(starts, len(rows))
        least = np.minimum.reduceat(s.conv[rows], starts)
        members = np.diff(np.append(starts, len(rows)))
        d = depth[starts]
        children = np.add.reduceat(((s.length[rows] > depth) & (owned[rows] <= depth + 1)).astype(np.int64), starts)
        leaves = np.add.reduceat(leaf[rows], starts)
        saved = np.add.reduceat(np.maximum(ahead[rows] - s.bytes_to(rows, max(j, 0)), 0), starts)
        owner = rows[s.conv[rows] == least[seg]]
        self_above = owned[owner] <= d - 1
        parent = np.where(self_above, least, up[owner])
        known = (self_above | up_known[owner]) & (d > 0)
        part = shared[starts]
        hashes, pieces = np.full(len(starts), EMPTY, dtype=object), []
        at_end = np.flatnonzero(s.length[rows] == depth)
        ids, node = s.conv[rows[at_end]], seg[at_end]
        keys = dict(zip(np.flatnonzero(part).tolist(), s.key(rows[starts[part]], j + 1)))
        cuts = np.append(np.flatnonzero(np.append(True, node[1:] != node[:-1])), len(node)) if len(node) else [0]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            k = int(node[lo])
            if not part[k]:
                hashes[k] = hashlib.sha256(",".join(map(str, ids[lo:hi].tolist())).encode()).hexdigest()
                continue
            step = PIECE // 20
            for a in range(lo, hi, step):
                some = ids[a:min(a + step, hi)].tolist()
                pieces.append((int(d[k]), keys[k], some[0], ",".join(map(str, some))))
        none = pa.nulls(len(starts), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(least), pa.array(d), _opt(parent, known), pa.array(members), pa.array(children), pa.array(leaves), pa.array(saved),
             pa.array(hashes, pa.string(), mask=part), pa.array([keys.get(k) for k in range(len(starts))], pa.binary()), none, pa.nulls(len(starts), pa.string())],
            names=[f.split()[0] for f in NODE.split(", ")])
        for lo in range(0, len(pieces), 256):
            some = pieces[lo:lo + 256]
            gap = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [gap, pa.array([p[0] for p in some], pa.int64()), gap, gap, gap, gap, gap, pa.nulls(len(some), pa.string()),
                 pa.array([p[1] for p in some], pa.binary()), pa.array([p[2] for p in some], pa.int64()), pa.array([p[3] for p in some], pa.string())],
                names=[f.split()[0] for f in NODE.split(", ")])


def _hashes(batches):
    """SHA-256 of each node's pieces, which come in order; the state of one node is held."""
    now, state = None, None
    for batch in batches:
        done = []
        for depth, key, piece in zip(*(batch.column(c).to_pylist() for c in ("depth", "key", "piece"))):
            if (depth, key) != now:
                if now:
                    done.append((*now, state.hexdigest()))
                now, state = (depth, key), hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["depth", "key", "sha"])
    if now:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, state.hexdigest())], names=["depth", "key", "sha"])


# ---- the trie ---------------------------------------------------------------------------------------------------

def prefix_trie(convs: DataFrame, turns: DataFrame, shard: int = SHARD) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row per node of the
    trie of ``turns`` (conv, depth from 1, h: digest of the turn, n: bytes); ``convs`` (conv) names all conversations."""
    spark = convs.sparkSession
    rows = written(_blocks(convs, turns), "trie-rows")
    size = rows.agg(F.sum(F.size("ns") + 1)).first()[0] or 0
    parts = max(-(-size // shard), min(spark.sparkContext.defaultParallelism, -(-size // 4096)), 1)
    ranged = lambda d: d.repartitionByRange(parts, "block", "b0", "lead", "rest", "conv")

    found = written(ranged(rows.drop("total")).mapInArrow(_own, OWN), "trie-owners")
    shared = written(found.where(F.col("kind") == SHARED_NODE).groupBy("depth", "key").agg(
        F.min("conv").alias("conv"), F.sum("n").alias("n"), F.sum("e").alias("e"), F.any_value("bytes").alias("bytes"),
        F.any_value("above").alias("above")), "trie-shared")
    least = shared.select("depth", "key", "conv").unionByName(found.where(F.col("kind") == BLOCK_END).select("depth", "key", "conv"))
    owned = found.where(F.col("kind") == OWNED).select("conv", "depth", "bytes", "up", "above", "leaf").unionByName(
        shared.select("conv", "depth", "bytes", F.lit(None).cast("long").alias("up"), "above", (F.col("n") == F.col("e")).alias("leaf")))
    best = owned.groupBy("conv").agg(F.min(F.struct("depth", "bytes", "up", "above")).alias("o"), F.max("leaf").alias("leaf")).select("conv", "o.*", "leaf")
    # the smallest member of the node above the first owned one: known inside a shard, else that of a shared node or block
    # end; the root's, which many need, is one row
    root = least.where("depth = 0").select(F.col("conv").alias("root"))
    best = best.crossJoin(F.broadcast(root)).withColumn("up", F.when(F.col("depth") == 1, F.col("root")).otherwise(F.col("up"))).drop("root")
    ask = best.where("up is null and depth > 1")
    named = least.select((F.col("depth") + 1).alias("depth"), F.col("key").alias("above"), F.col("conv").alias("seen"))
    told = ask.join(named, ["depth", "above"]).select("conv", "depth", "bytes", F.col("seen").alias("up"), "leaf")
    known = written(best.where("up is not null or depth <= 1").select("conv", "depth", "bytes", "up", "leaf").unionByName(told), "trie-owned")

    given = rows.join(known.select("conv", F.col("depth").alias("own_depth"), F.col("bytes").alias("own_bytes"), "up", "leaf"), "conv", "left").select(
        *[c for c in rows.columns if c != "total"], F.coalesce("own_depth", F.col("length") + 1).alias("own_depth"),
        F.coalesce("own_bytes", "total").alias("own_bytes"), "up", F.coalesce("leaf", F.lit(False)).alias("leaf"))
    nodes = written(ranged(given).mapInArrow(_nodes, NODE), "trie-nodes")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    sums = nodes.where("key is not null and piece is null").groupBy("depth", "key").agg(
        F.min(F.struct("conv_id", "parent_conv_id")).alias("o"), *[F.sum(c).alias(c) for c in names[3:7]])
    hashes = (nodes.where("piece is not null").select("depth", "key", "first", "piece").repartition("depth", "key")
              .sortWithinPartitions("depth", "key", "first").mapInArrow(_hashes, "depth long, key binary, sha string"))
    whole = sums.join(hashes, ["depth", "key"], "left").select("o.conv_id", "depth", "o.parent_conv_id", *names[3:7],
                                                               F.coalesce("sha", F.lit(EMPTY)).alias("ends_sha256"))
    return nodes.where("key is null").select(*names).unionByName(whole)
