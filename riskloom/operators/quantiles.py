"""Exact quantiles of whole groups, safe for groups of any size.

Spark's ``percentile`` holds a group's values in one task. That is fine up to HOT_ROWS rows.
Larger groups are ranked across tasks: their distinct values are range-partitioned, partition
totals tell where each wanted rank lies, and only those partitions are ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.scalars import field
from riskloom.operators.skew import HOT_ROWS, by_key
from riskloom.session import stage_path


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    probs: Sequence[float],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One row per key; each column becomes an array of its linearly interpolated quantiles."""
    keys = list(keys)
    df = df.select(*[field(k) for k in keys], *[field(c).cast("double").alias(c) for c in columns])
    points = F.array(*[F.lit(float(p)) for p in probs])
    percentiles = [F.percentile(field(c), points).alias(c) for c in columns]
    return by_key(
        df,
        keys,
        lambda rows: rows.groupBy(*keys).agg(*percentiles),
        hot_rows,
        build_hot=lambda rows: quantiles_across_tasks(rows, keys, columns, probs),
    )


def quantiles_across_tasks(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], probs: Sequence[float]
) -> DataFrame:
    """The same result for a few keys of any size, without a group's values in one task."""
    keys = list(keys)
    df = df.select(*[field(k) for k in keys], *[field(c).cast("double").alias(c) for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("_col"), field(c).alias("_v")) for c in columns])
    long = df.select(*keys, F.inline(cells)).where(F.col("_v").isNotNull())
    values = long.groupBy(*keys, "_col", "_v").agg(F.count(F.lit(1)).alias("_n"))
    # A key whose values are all NULL has no ranks, but still has a row.
    return df.select(*keys).distinct().join(quantiles_of_counts(values, keys, columns, probs), keys, "left")


def quantiles_of_counts(values: DataFrame, keys: Sequence[str], columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Quantiles from a table of values: keys, _col (one of ``columns``), _v (not NULL) and _n, how often it occurs.

    One row per key with any value; each column an array, or NULL without values.
    """
    keys, spark = list(keys), values.sparkSession
    group = [*keys, "_col"]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Written out so that every later step sees the same split, even if a task is rerun.
    path = stage_path(spark, "ranged")
    values.repartitionByRange(tasks, *group, "_v").withColumn(
        "_part", F.spark_partition_id()
    ).write.parquet(path)
    ranged = spark.read.parquet(path)

    # At most one row per (group, range partition).
    by_part = Window.partitionBy(*group).orderBy("_part")
    before = by_part.rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        ranged.groupBy(*group, "_part")
        .agg(F.sum("_n").alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .withColumn("_total", F.sum("_rows").over(Window.partitionBy(*group)))
    )
    targets = F.array(
        *[
            F.struct(F.lit(i).alias("_p"), F.lit(end).alias("_end"), position.cast("long").alias("_pos"))
            for i, p in enumerate(probs)
            for end, position in (
                ("low", F.floor(F.lit(float(p)) * (F.col("_total") - 1))),
                ("high", F.ceil(F.lit(float(p)) * (F.col("_total") - 1))),
            )
        ]
    )
    wanted = parts.select(*group, "_part", "_before", "_rows", "_total", F.inline(targets)).where(
        (F.col("_pos") >= F.col("_before")) & (F.col("_pos") < F.col("_before") + F.col("_rows"))
    )
    # Two rows per key, column and quantile. A partition of a group is no larger than a range, so these joins need no
    # broadcast where keys are many.
    in_part = Window.partitionBy(*group, "_part").orderBy("_v")
    holding = wanted.select(*group, "_part", "_before").distinct()
    ordered = ranged.join(holding, [*group, "_part"]).withColumn(
        "_end_pos", F.col("_before") + F.sum("_n").over(in_part)
    )
    found = ordered.drop("_before", "_rows").join(wanted.drop("_before", "_rows"), [*group, "_part"]).where(
        (F.col("_pos") < F.col("_end_pos")) & (F.col("_pos") >= F.col("_end_pos") - F.col("_n"))
    )

    def quantile(column: str, i: int, p: float):
        here = (F.col("_col") == column) & (F.col("_p") == i)
        low = F.max(F.when(here & (F.col("_end") == "low"), F.col("_v")))
        high = F.max(F.when(here & (F.col("_end") == "high"), F.col("_v")))
        position = F.lit(float(p)) * (F.max(F.when(here, F.col("_total"))) - 1)
        return low + (high - low) * (position - F.floor(position))

    arrays = []
    for c in columns:
        found_values = F.array(*[quantile(c, i, p) for i, p in enumerate(probs)])
        arrays.append(F.when(found_values[0].isNotNull(), found_values).alias(c))
    return found.groupBy(*keys).agg(*arrays)
