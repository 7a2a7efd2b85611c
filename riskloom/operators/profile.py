"""Quick looks at a table: preview, shape, value frequencies, category lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.scalars import field


def preview(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """First n rows in a fixed order (top-n per task, no full sort)."""
    return df.orderBy(*order_by).limit(n)


def table_shape(df: DataFrame) -> DataFrame:
    """One row with the row count and the column count."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_columns", F.lit(len(df.columns)).cast("long")
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Frequency of each non-NULL value, most frequent first."""
    counts = df.where(field(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), field(column))


def columns_of(df: DataFrame, kind: type[T.DataType], exclude: Sequence[str] = ()) -> list[str]:
    """Names of the columns of one type family, keys excluded by name."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kind) and f.name not in exclude]


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return columns_of(df, T.NumericType, exclude)


def string_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return columns_of(df, T.StringType, exclude)
