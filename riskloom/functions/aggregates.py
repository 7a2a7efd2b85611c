"""Aggregate builders by name, all built-in and all with map-side partial aggregation.

``aggregate(fn, column, where)`` restricts the aggregate to the rows that satisfy ``where``. A
group in which no row does yields NULL, exactly as if the filtered subset had been aggregated
on its own and left-joined back; so many subsets share one scan and one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.functions.scalars import drop_nan, field


def _sum(c: Column, rows: Column) -> Column:
    total = F.sum(c)
    return F.when(total.isNull(), 0).otherwise(drop_nan(total))


def _adjusted_skew(c: Column, rows: Column) -> Column:
    n = F.count(c)
    corrected = F.skewness(c) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0))
    return F.when(n >= 3, drop_nan(F.coalesce(corrected, F.lit(0.0))))


def _when_complete(value: Column, c: Column, rows: Column) -> Column:
    """The value, or NULL if the group holds a missing input."""
    return F.when(F.count(c) == rows, drop_nan(value))


def _iqr(c: Column, rows: Column) -> Column:
    quartiles = F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return _when_complete(quartiles[2] - quartiles[0], c, rows)


def _median(c: Column, rows: Column) -> Column:
    # The same three-point percentile as _iqr, so that Spark computes both from one buffer.
    return F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))[1]


# median and iqr keep the distinct values of a group in one task: used as they stand only on groups of
# bounded size (last-k rows); recipes rank those of hot keys across tasks.
AGGREGATES = {
    "sum": _sum,
    "mean": lambda c, rows: drop_nan(F.avg(c)),
    "min": lambda c, rows: F.min(c),
    "max": lambda c, rows: F.max(c),
    "var": lambda c, rows: drop_nan(F.var_samp(c)),
    "std": lambda c, rows: drop_nan(F.stddev_samp(c)),
    "count": lambda c, rows: F.count(c),
    "size": lambda c, rows: rows,
    "nunique": lambda c, rows: F.count_distinct(c),
    "skew": _adjusted_skew,
    "skew_pop": lambda c, rows: _when_complete(F.skewness(c), c, rows),
    "kurt": lambda c, rows: _when_complete(F.kurtosis(c), c, rows),
    "median": _median,
    "iqr": _iqr,
}


def aggregate(fn: str, c: Column | str, where: Column | None = None) -> Column:
    """Aggregate ``fn`` over a column, optionally over the rows that satisfy ``where``."""
    c = field(c) if isinstance(c, str) else c
    if where is None:
        return AGGREGATES[fn](c, F.count(F.lit(1)))
    rows = F.count(F.when(where, 1))
    value = AGGREGATES[fn](F.when(where, c), rows)
    return F.when(rows > 0, value) if fn in ("sum", "count", "size", "nunique") else value
