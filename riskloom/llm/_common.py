"""Helpers shared by the operators of this package."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import stage_path

# Words are runs of characters other than ASCII white space. Splitting the UTF-8 bytes gives the same
# words, since no byte of a longer character lies in that range, and bytes.lower() changes A-Z only.
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return (data.lower() if lower else data).split()


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that few of them are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage and survives lost executors."""
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_of_id(c: Column | str = "doc_id") -> Column:
    """CRC-32 of the id written as text."""
    return F.crc32((F.col(c) if isinstance(c, str) else c).cast("string").cast("binary"))


def text_characters(docs: DataFrame, text: str = "text") -> int:
    """All characters of a text column, to size the number of shards."""
    return int(docs.agg(F.coalesce(F.sum(F.length(text)), F.lit(0))).first()[0])


def shards_for(amount: int, each: int, least: int = 8) -> int:
    """Number of shards of about ``each`` units; grows with the input without a limit."""
    return max(least, -(-amount // each))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def running_total(
    df: DataFrame, group: str, order: list[str], value: str, out: str, least_rows: int = 256
) -> DataFrame:
    """Sum of ``value`` over the rows before this one in its group, in order of a hash.

    Rows of a group are ordered by (bucket, order columns), bucket being a range of the leading order
    column, a 64-bit hash. Each bucket is summed apart and bucket totals are added up, so a group with
    a third of all rows is spread over as many tasks as it has buckets. The group may be null.
    """
    # As many rows in a bucket as buckets: neither sum is long for one task.
    total = df.count()
    buckets = max(1, -(-total // max(least_rows, math.isqrt(total))))
    # The hash covers the signed 64-bit range evenly; its upper 31 bits choose the bucket.
    upper = F.shiftrightunsigned(F.col(order[0]), 33)
    keyed = df.withColumn("_bucket", F.floor(upper * F.lit(buckets) / F.lit(2**31)).cast("long"))
    inside = (
        Window.partitionBy(group, "_bucket")
        .orderBy(F.col("_bucket"), *order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    keyed = keyed.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    totals = keyed.groupBy(group, "_bucket").agg(F.sum(value).alias("_sum"))
    across = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        F.col(group).alias("_g"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(across), F.lit(0)).alias("_before")
    )
    joined = keyed.join(totals, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_bucket") == F.col("_b")))
    return joined.withColumn(out, F.col("_before") + F.col("_inside")).drop("_bucket", "_inside", "_g", "_b", "_before")


def tokenizer_path(name: str) -> str:
    """A vocabulary file of the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)
