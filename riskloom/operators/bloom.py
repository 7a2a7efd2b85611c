"""A Bloom filter of built-in bitmap functions, to drop rows before they are shuffled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.scalars import field

# Fixed value: bits of one bitmap of the built-in functions.
BITMAP = 32_768
# Bits for each member, and at most: 64 MB are broadcast. With more members the filter lets more rows through.
BITS_EACH = 16
MOST_BITS = 2**29


def likely_members(rows: DataFrame, members: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every row whose ``columns`` are those of a member, and about one in sixteen of the others.

    ``members`` should be a written table: it is counted and read here. Its bits are broadcast, MOST_BITS at most.
    """
    maps = min(MOST_BITS // BITMAP, max(1, -(-members.count() * BITS_EACH // BITMAP)))
    place = F.pmod(F.xxhash64(*[field(c) for c in columns]), F.lit(maps * BITMAP))
    bucket, bit = F.floor(place / BITMAP).cast("int"), F.pmod(place, F.lit(BITMAP))
    bits = members.select(bucket.alias("_bucket"), bit.alias("_bit")).groupBy("_bucket").agg(
        F.bitmap_construct_agg("_bit").alias("_bits")
    )
    byte = F.substring(F.col("_bits"), F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))
    value = F.conv(F.hex(byte), 16, 10).cast("int")
    is_set = F.getbit(value, F.pmod(F.col("_bit"), F.lit(8)).cast("int")) == 1
    placed = rows.withColumns({"_bucket": bucket, "_bit": bit})
    return placed.join(F.broadcast(bits), "_bucket").where(is_set).select(*[field(c) for c in rows.columns])
