"""Bit filters: a bounded, broadcast superset test that keeps rows without a partner from being shuffled.

A filter has a bit per hash value, taken from its leading bits, 16 bits a key and at most ``2 ** MOST_BITS`` (32 MB). A key of the
filter always passes; a few others do too (about 1 in 16, more beyond the bound), so what must be exact still follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BITS = 28
CHUNK_BITS = 12  # bits a row


def key_hash(column) -> Column:
    """32 bits of hash, as an int: four bytes a row in an exchange."""
    return F.shiftright(F.xxhash64(column), 32).cast("int")


def n_bits(n_keys: int) -> int:
    return min(MOST_BITS, max(CHUNK_BITS, (16 * max(n_keys, 1) - 1).bit_length()))


def chunks(hashes: DataFrame, bits: int) -> DataFrame:
    """``(k, words)``: the filter of the hashes in column ``h``, ``2 ** CHUNK_BITS`` bits a row; chunks without a bit are left out."""
    at = hashes.select(F.shiftrightunsigned("h", 32 - bits).cast("long").alias("bit"))
    words = at.groupBy(F.shiftright("bit", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("m"))
    part = words.groupBy(F.shiftright("w", CHUNK_BITS - 6).alias("k")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("w").bitwiseAND(63).alias("w"), "m"))).alias("m"))
    return part.select("k", F.transform(F.sequence(F.lit(0).cast("long"), F.lit((1 << CHUNK_BITS - 6) - 1).cast("long")),
                                        lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("words"))


def passing(rows: DataFrame, column, filter_: DataFrame, bits: int) -> DataFrame:
    """The rows whose ``column`` may be among the filter's keys; the filter is broadcast, rows stay where they are."""
    at = rows.withColumn("_bit", F.shiftrightunsigned(key_hash(column), 32 - bits).cast("long"))
    met = at.join(F.broadcast(filter_.withColumnRenamed("k", "_k")), F.shiftright("_bit", CHUNK_BITS) == F.col("_k"))
    return met.where(F.expr("shiftright(words[cast(shiftright(_bit, 6) & 63 as int)], cast(_bit & 63 as int)) & 1 = 1")).select(*rows.columns)
