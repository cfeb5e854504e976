"""Operator 5: exact n-gram Jaccard self-join by universe partition and the pigeonhole principle.

A document's set is its distinct shingles of ``n`` words. Two sets link if ``100 * |intersection| >= percent *
|union|``, so their symmetric difference is at most ``H = (1 - t) / (1 + t) * (|r| + |s|)``. Sizes are cut into
bands that grow by 1 / t, so partners are in the same or the next band. Within a band's scheme the universe of
shingles is hashed into segments; differences spread over segments, so with enough segments at least one
differs in nothing (or, where one-deletion neighbourhoods are allotted, in at most one shingle).

Allocation: small sets (few segments) may give segments a one-deletion neighbourhood, worth two thresholds; the
cheapest mix of both by estimated cost (signatures plus expected chance matches) is taken for every band. Large
sets get some segments to spare: all are indexed, and once the groups are known a set leaves out as many of
its most crowded ones as it has to spare, and probes with the others (any H + 1 of them suffice).

Signatures travel packed, one row per block and bucket, with the class (hash of the whole set) instead of a
document, so exact copies are one entry. Sets that share a signature form a group. In each round the members
of a group stand in a ring (a new order each time, large groups in several rings) and meet the
next few members of other components; a class is compared with the few it meets in most groups, so
groups of true copies become one component after a few rounds of work that is linear in classes. Groups still in several
components then give all their remaining probe pairs across components, each once (a pair in several groups is taken
from the first), so no link that joins components is missed; of these, pairs whose counts of shingles by ``CELLS`` hash cells
already differ by more than H can't link and are left out. Pairs are verified on the whole sets of 64-bit shingle hashes. Links between members that
are already connected are not enumerated: components are exact, ``n_links`` counts are not offered.

Defined cases: null and empty texts and texts without words have ``n_shingles`` 0 and link with nothing; texts
with fewer than ``n`` words have one shingle, the whole sequence; repeated rows are exact copies; a null id
never becomes a component's id unless it stands alone; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termlens.llm.common import components, mixed, portions, span_hashes, squeeze, unsqueeze, written

BLOCK_BYTES = 6 << 20
SMALL = 8  # bands with at most so many thresholds may use one-deletion neighbourhoods
SPARE = 0.3  # further segments of larger bands
CELLS = 256  # cells of the counts that bound a difference from below; a count is one byte, 127 at most
ROUNDS, NEXT, RING = 3, 4, 2048  # rings: rounds, members compared with (in a group, and by a class in all), members a ring
FIRST = 16  # a class's first groups by hash, by which a pair that shares several is taken from one
CHANCE = 40.0  # cost of a segment's chance match against that of a signature
FILTER_BITS = 1 << 23  # bits of the broadcast filter of classes to be verified: 1 MB


class Bands:
    """Size bands for a threshold, and the segment scheme of each band."""

    def __init__(self, percent: int):
        if not 50 <= percent <= 100:
            raise ValueError("percent must be between 50 and 100")
        self.percent = percent
        self.lows = [1]

    def band(self, size: int) -> int:
        """The band of a size; band k holds lows[k] <= size < lows[k + 1]."""
        while self.lows[-1] <= size:
            self.lows.append(self.lows[-1] * 100 // self.percent + 1)
        return int(np.searchsorted(self.lows, size, side="right")) - 1

    def partner(self, larger: int, smaller: int) -> bool:
        return 100 * smaller >= self.percent * larger

    @functools.lru_cache(maxsize=4096)  # noqa: B019 - one object lives as long as a task
    def scheme(self, band: int) -> tuple[int, int, int]:
        """(segments, how many of them with one-deletion neighbourhoods, exact segments a set probes with)."""
        self.band(self.lows[-1] if band + 1 >= len(self.lows) else 1)
        while band + 1 >= len(self.lows):
            self.band(self.lows[-1])
        most = self.lows[band + 1] - 1
        need = (100 - self.percent) * 2 * most // (100 + self.percent) + 1
        if need > SMALL:
            return need + math.ceil(SPARE * need), 0, need
        def cost(deletions):
            exact = max(0, need - 2 * deletions)
            per = most / (deletions + exact)
            return deletions * (1 + per) + exact + CHANCE * (deletions + exact) * math.exp(-0.7 * per)
        deletions = min(range((need + 1) // 2 + 1), key=cost)
        exact = max(0, need - 2 * deletions)
        return deletions + exact, deletions, exact


def signatures(shingles: np.ndarray, band: int, scheme: tuple[int, int, int]):
    """The signatures of one set under a band's scheme."""
    segments, deletions, _ = scheme
    seed = mixed(np.array([band + 1], dtype=np.uint64))[0]
    spread = mixed(shingles ^ seed)
    segment = ((spread >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    weight = mixed(shingles + np.uint64(0x632BE59BD9B4E019))
    order = np.argsort(segment, kind="stable")
    segment, weight = segment[order].astype(np.int64), weight[order]
    sizes = np.bincount(segment, minlength=segments)
    sums = np.zeros(segments, dtype=np.uint64)
    full = np.flatnonzero(sizes)
    sums[full] = np.add.reduceat(weight, (np.cumsum(sizes) - sizes)[full])
    name = mixed((np.uint64(band) << np.uint64(32)) + np.arange(segments, dtype=np.uint64))
    out = mixed(sums ^ name)
    if not deletions:
        return out
    near = segment < deletions
    less = mixed((sums[segment[near]] - weight[near]) ^ name[segment[near]])
    return np.concatenate([out, less])


def _sets(texts, n: int):
    """For each text its sorted distinct shingle hashes."""
    for part in portions(texts):
        yield from _portion_sets(part, n)


def _portion_sets(texts, n: int):
    streams = [b" ".join(t.encode().lower().split()) + b"\n" if t else b"\n" for t in texts]
    raw = np.frombuffer(b"".join(streams), np.uint8)
    inside = (raw != 32) & (raw != 10)
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    starts = np.flatnonzero(edge == 1)
    word = span_hashes(raw, starts, np.flatnonzero(edge == -1))
    at = np.searchsorted(starts, np.cumsum([0, *map(len, streams)]))
    odd = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5,
                                  0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
    if n > len(odd):
        raise ValueError(f"at most {len(odd)} words a shingle")
    grams = np.zeros(max(0, len(word) - n + 1), dtype=np.uint64)
    for k in range(n):
        grams += word[k:len(word) - n + 1 + k] * odd[k] if len(grams) else grams
    grams = mixed(grams)
    for lo, hi in zip(at[:-1], at[1:]):
        if hi - lo >= n:
            x = np.sort(grams[lo:hi - n + 1])
            yield x[np.concatenate([[True], x[1:] != x[:-1]])]
        elif hi > lo:
            total = np.array([hi - lo], dtype=np.uint64)
            for k in range(hi - lo):
                total = mixed(total + word[lo + k:lo + k + 1] * odd[k])
            yield total
        else:
            yield np.zeros(0, dtype=np.uint64)


def _class_of(shingles: np.ndarray) -> np.int64:
    """A 64-bit hash of the whole set and its size."""
    total = np.add.reduce(mixed(shingles ^ np.uint64(0x94D049BB133111EB)), keepdims=True)
    return mixed(total + np.array([len(shingles)], dtype=np.uint64)).view(np.int64)[0]


def _members(n: int):
    def run(batches):
        for batch in batches:
            found = [(len(s), int(_class_of(s)) if len(s) else None) for s in _sets(batch.column(1).to_pylist(), n)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())],
                names=["id", "n_shingles", "class"])
    return run


def _index(n: int, percent: int, buckets: int):
    """Packed signatures: one row per block of texts and bucket."""
    def pack(found: dict):
        classes = np.array(list(found), dtype=np.int64)
        sizes = np.array([x[0] for x in found.values()], dtype=np.int64)
        sig = np.concatenate([x[1] for x in found.values()])
        probe = np.concatenate([x[2] for x in found.values()])
        owner = np.repeat(np.arange(len(classes), dtype=np.uint32), [len(x[1]) for x in found.values()])
        bucket = (sig % np.uint64(buckets)).astype(np.uint16)
        order = np.argsort(bucket, kind="stable")
        at = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))])
        sig, owner, probe = sig[order], owner[order], probe[order]
        rows = []
        for k in np.flatnonzero(np.diff(at)):
            part = slice(at[k], at[k + 1])
            used, local = np.unique(owner[part], return_inverse=True)
            rows.append((int(k), squeeze(sig[part]), squeeze(np.diff(local.reshape(-1), prepend=0).astype(np.int32)), squeeze(probe[part].view(np.uint8)),
                         squeeze(classes[used]), squeeze(sizes[used])))
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]],
                                          names=["bucket", "sigs", "owners", "probes", "classes", "sizes"])

    def run(batches):
        bands, found, size = Bands(percent), {}, 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for text, shingles in zip(texts, _sets(texts, n)):
                if not len(shingles):
                    continue
                key = int(_class_of(shingles))
                if key in found:
                    continue
                own = bands.band(len(shingles))
                sigs, probes = [], []
                for band in (own, own + 1):
                    scheme = bands.scheme(band)
                    if scheme[2] <= 1 and scheme[1] == 0:
                        continue  # no difference allowed: partners would be exact copies, one class
                    sigs.append(signatures(shingles, band, scheme))
                    probes.append(np.full(len(sigs[-1]), band == own))
                if sigs:
                    found[key] = (len(shingles), np.concatenate(sigs), np.concatenate(probes))
                    size += len(text)
                if size >= BLOCK_BYTES:
                    yield pack(found)
                    found, size = {}, 0
        if found:
            yield pack(found)
    return run


GROUPS = "gid long, class long, size long, probe boolean, members long, copies long, spare long"


def _groups(percent: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """The groups of one bucket: signatures that several classes share."""
        sigs, classes, sizes, probes = [], [], [], []
        for r in rows.itertuples():
            owner = np.cumsum(unsqueeze(r.owners, np.int32), dtype=np.int64)
            sigs.append(unsqueeze(r.sigs, np.uint64))
            classes.append(unsqueeze(r.classes, np.int64)[owner])
            sizes.append(unsqueeze(r.sizes, np.int64)[owner])
            probes.append(unsqueeze(r.probes, np.uint8))
        sig = np.concatenate(sigs)
        del sigs
        twice = np.sort(sig)
        twice = twice[1:][twice[1:] == twice[:-1]]
        twice = twice[np.concatenate([[True], twice[1:] != twice[:-1]])] if len(twice) else twice
        if not len(twice):
            return pd.DataFrame({c.split()[0]: [] for c in GROUPS.split(", ")})
        at = np.minimum(np.searchsorted(twice, sig), len(twice) - 1)
        keep = twice[at] == sig
        f = pd.DataFrame({"g": at[keep], "class": np.concatenate(classes)[keep], "size": np.concatenate(sizes)[keep], "probe": np.concatenate(probes)[keep] > 0})
        f = f.groupby(["g", "class"], as_index=False).agg(size=("size", "first"), probe=("probe", "any"))
        # groups of the same members (and probes) say the same: one is kept, and counted as so many
        token = mixed(f["class"].to_numpy().view(np.uint64))
        f["h"] = mixed(token + f["probe"].to_numpy().astype(np.uint64)).view(np.int64)
        g = f.groupby("g")
        kept = pd.DataFrame({"members": g["class"].size(), "any": g["probe"].any(), "h": g["h"].sum()})
        kept = kept[(kept.members > 1) & kept["any"]]
        kept["copies"] = kept.groupby(["members", "h"])["any"].transform("size")
        kept = kept.drop_duplicates(["members", "h"])
        f = f.join(kept[["members", "copies"]], on="g", how="inner")
        bands = Bands(percent)
        spare = {}
        for size in f["size"].unique():
            segments, deletions, need = bands.scheme(bands.band(int(size)))
            spare[size] = 0 if deletions else segments - need
        f["spare"] = f["size"].map(spare)
        f["gid"] = (np.int64(rows.bucket.iloc[0]) << 40) + f["g"]
        return f[["gid", "class", "size", "probe", "members", "copies", "spare"]]
    return run


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
    return run


def _set_rows(n: int, wanted):
    def run(batches):
        bits = wanted.value
        done = set()
        for batch in batches:
            classes, sets, cells, size = [], [], [], 0
            for shingles in _sets(batch.column(0).to_pylist(), n):
                if len(shingles):
                    key = int(_class_of(shingles))
                    at = key % FILTER_BITS
                    if bits[at >> 3] >> (at & 7) & 1 and key not in done:
                        if len(done) < 1 << 20:
                            done.add(key)
                        classes.append(key)
                        sets.append(shingles.tobytes())
                        cells.append(np.minimum(np.bincount((mixed(shingles) % np.uint64(CELLS)).astype(np.int64), minlength=CELLS), 127).astype(np.int8))
                        size += len(sets[-1])
                        if size >= BLOCK_BYTES:
                            yield _rows(classes, sets, cells)
                            classes, sets, cells, size = [], [], [], 0
            yield _rows(classes, sets, cells)
    return run


def _rows(classes, sets, cells):
    return pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(sets, pa.binary()), pa.array(cells, pa.list_(pa.int8()))],
                                      names=["class", "set", "cells"])


def sets_of(named: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """(class, set, cells) of the classes named; cells are its counts of shingles by hash cell. Sets are built anew from the texts; a bit filter of fixed size keeps
    most other texts' sets from being shuffled."""
    spark = named.sparkSession
    bit = F.pmod(F.col("class"), F.lit(FILTER_BITS))
    maps = named.select(F.bitmap_bucket_number(bit).alias("k"), F.bitmap_bit_position(bit).alias("p")).groupBy("k").agg(F.bitmap_construct_agg("p").alias("bits")).collect()
    bits = bytearray(FILTER_BITS // 8 + 8192)
    for row in maps:  # bucket k holds the numbers (k - 1) * 32768 + 1 .. k * 32768; 0 is in bucket 0
        _place(bits, row.k, bytes(row.bits))
    wanted = spark.sparkContext.broadcast(bytes(bits))
    sets = docs.mapInArrow(_set_rows(n, wanted), "class long, set binary, cells array<tinyint>")
    return written(sets.join(named, "class", "left_semi").groupBy("class").agg(F.first("set").alias("set"), F.first("cells").alias("cells")), "jaccard-sets")


def links_of(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets link."""
    both = (pairs.join(sets.select(F.col("class").alias("a"), F.col("set").alias("x")), "a")
            .join(sets.select(F.col("class").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y"))
    return written(both.mapInArrow(_verify(percent), "a long, b long"), "jaccard-links")


def _place(bits: bytearray, bucket: int, part: bytes) -> None:
    """Or one bitmap bucket into the filter, by the numbers that Spark's bit positions stand for."""
    # bit_position(v) = (v - 1) % 32768 and bucket_number(v) = 1 + (v - 1) / 32768 for v > 0; v = 0: bucket 0, position 0
    if bucket == 0:
        bits[0] |= part[0] & 1
        return
    base = (bucket - 1) * 32768 + 1
    for at in np.flatnonzero(np.unpackbits(np.frombuffer(part, np.uint8), bitorder="little")):
        v = base + int(at)
        bits[v >> 3] |= 1 << (v & 7)


def _fits(percent: int, size, probe, size2, probe2):
    """May the two sets be partners, and does the larger one probe?"""
    return ((100 * F.least(size, size2) >= percent * F.greatest(size, size2))
            & ((probe & (size >= size2)) | (probe2 & (size2 >= size))))


def pairs_across(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs of classes of different components that share a group in which the larger one probes and whose cells allow a link.
    ``members`` are (gid, class, size, component, probe, cells). A pair in several groups is taken from the first one by hash; only
    pairs whose first common one is behind a class's ``FIRST`` first may come more than once."""
    at = members.withColumn("at", F.xxhash64("gid"))
    first = lambda c: F.slice(F.sort_array(F.collect_set(c)), 1, FIRST)  # noqa: E731 - bounded by a set's segments
    at = written(at.join(at.groupBy("class").agg(first(F.when(F.col("probe"), F.col("at"))).alias("probed"), first("at").alias("all")), "class"), "jaccard-last")
    other = at.select(F.col("gid").alias("g2"), F.col("class").alias("c2"), F.col("size").alias("s2"), F.col("component").alias("k2"),
                      F.col("probe").alias("p2"), F.col("cells").alias("e2"), F.col("probed").alias("probed2"), F.col("all").alias("all2"))
    # what the larger one's probes and the other's groups have in common are groups that give this pair
    before = F.array_min(F.when(F.col("size") >= F.col("s2"), F.array_intersect("probed", "all2")).otherwise(F.array_intersect("probed2", "all")))
    apart = F.aggregate(F.zip_with("cells", "e2", lambda x, y: F.abs(x - y)), F.lit(0), lambda total, x: total + x)
    return at.join(other, (F.col("gid") == F.col("g2")) & (F.col("component") < F.col("k2"))
                   & _fits(percent, F.col("size"), F.col("probe"), F.col("s2"), F.col("p2"))
                   & (F.coalesce(before, F.col("at")) >= F.col("at"))
                   & ((100 + percent) * apart <= (100 - percent) * (F.col("size") + F.col("s2")))).select(
        F.least("class", "c2").alias("a"), F.greatest("class", "c2").alias("b"))


def classes(docs: DataFrame, id_col: str, text_col: str, n: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, class, component): ``component`` is the smallest class reachable by links."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).alias("text"))
    members = written(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
                      .mapInArrow(_members(n), "id long, n_shingles long, class long"), "jaccard-members")
    total = members.agg(F.sum("n_shingles").alias("s")).first().s or 0
    buckets = int(min(4096, max(3 * spark.sparkContext.defaultParallelism, total // 1_500_000)))
    packed = texts.mapInArrow(_index(n, percent, buckets), "bucket int, sigs binary, owners binary, probes binary, classes binary, sizes binary")
    raw = packed.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(_groups(percent), GROUPS)
    # allocation by cost: a set's most crowded segments go first, as many as it has to spare
    crowd = Window.partitionBy("class").orderBy(F.desc("members"), "gid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spent = F.sum(F.when(F.col("probe"), F.col("copies")).otherwise(0)).over(crowd)
    groups = written(raw.withColumn("probe", F.col("probe") & (spent > F.col("spare"))).drop("copies", "spare"), "jaccard-groups")
    # groups of the same members and probes in several buckets say the same: one is kept
    token = [F.bit_xor(F.xxhash64("class", "probe", F.lit(k))).alias(f"h{k}") for k in range(2)]
    live = groups.groupBy("gid").agg(F.max("probe").alias("any"), F.count("*").alias("n"), *token).where("any")
    live = live.groupBy("n", "h0", "h1").agg(F.min("gid").alias("gid")).select("gid")
    groups = written(groups.join(live, "gid", "left_semi"), "jaccard-probed")
    sets = sets_of(groups.select("class").distinct(), texts, n)
    links, tried, found = None, None, None

    def still_open():
        """Members, with their components, of the groups that are in several components."""
        if found is None:
            return groups.withColumn("component", F.col("class"))
        at = groups.join(found.select(F.col("node").alias("class"), "component"), "class", "left").withColumn("component", F.coalesce("component", "class"))
        apart = at.groupBy("gid").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("gid")
        return written(at.join(apart, "gid", "left_semi"), "jaccard-open")

    def compared(pairs):
        """Verify new pairs; False if there are none."""
        nonlocal links, tried, found
        pairs = pairs.distinct()
        pairs = written(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "jaccard-pairs")
        if not pairs.limit(1).count():
            return False
        tried = pairs if tried is None else tried.unionByName(pairs)
        new = links_of(pairs, sets, percent)
        links = new if links is None else links.unionByName(new)
        if not new.limit(1).count():
            return False
        found = components(links)
        return True

    for k in range(ROUNDS):
        at = still_open().withColumn("turn", F.xxhash64("class", F.lit(k)))
        ring = F.pmod(F.shiftright("turn", 20), F.ceil(F.col("members") / RING))
        line = Window.partitionBy("gid", "ring").orderBy("turn", "class")
        me = F.struct("class", "size", "component", "probe")
        near = at.withColumn("ring", ring).withColumn("others", F.array(*[F.lead(me, j).over(line) for j in range(1, NEXT + 1)]))
        near = near.select("class", "size", "component", "probe", F.explode("others").alias("o")).where("o IS NOT NULL AND component <> o.component")
        near = near.where(_fits(percent, F.col("size"), F.col("probe"), F.col("o.size"), F.col("o.probe"))).groupBy("class", F.col("o.class").alias("other")).agg(F.count("*").alias("shared"))
        best = Window.partitionBy("class").orderBy(F.desc("shared"), F.xxhash64("class", "other"), "other")
        near = near.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= NEXT)
        if not compared(near.select(F.least("class", "other").alias("a"), F.greatest("class", "other").alias("b"))) and k:
            break
    compared(pairs_across(still_open().join(sets.select("class", "cells"), "class"), percent))
    if found is None:
        return members.select("id", "n_shingles", "class", F.col("class").alias("component"))
    return members.join(found.select(F.col("node").alias("class"), "component"), "class", "left").select(
        "id", "n_shingles", "class", F.coalesce("component", "class").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str, text_col: str, n: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id): the smallest id reachable by links, a row for each row of ``docs``."""
    found = written(classes(docs, id_col, text_col, n, percent), "jaccard-classes")
    least = found.where("component IS NOT NULL").groupBy(F.col("component").alias("k")).agg(F.min("id").alias("least"))
    return found.join(least, F.col("component") == F.col("k"), "left").select(
        "id", "n_shingles", F.coalesce("least", "id").alias("component_id"))


def representatives(docs: DataFrame, id_col: str, text_col: str, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group left, the one with the smallest id; same columns. Texts without words
    are in no group and stay. Rows that share that id stay once per group they lead, in md5 order of the text."""
    found = written(classes(docs, id_col, text_col, n, percent), "jaccard-classes")
    lead = found.where("component IS NOT NULL").groupBy("component").agg(F.min("id").alias("id")).select("id")
    alone = found.where("component IS NULL").select("id")
    kept = lead.unionByName(alone).groupBy(F.col("id").alias("jj_id")).agg(F.count("*").alias("jj_n"))
    rows = docs.join(kept, F.col(id_col).cast("long").eqNullSafe(F.col("jj_id")))
    nth = F.row_number().over(Window.partitionBy(id_col).orderBy(F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    return rows.withColumn("jj_nth", nth).where(F.col("jj_nth") <= F.col("jj_n")).select(docs.columns)
