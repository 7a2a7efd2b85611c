"""Declarative recipe aggregation: many (column, function) pairs, one shuffle."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.aggregates import aggregate
from riskloom.functions.scalars import drop_nan, field
from riskloom.operators.quantiles import quantiles_across_tasks
from riskloom.operators.skew import HOT_ROWS, Clustered, by_key, not_null_keys

Spec = tuple[str, str]

# The five statistics every plain recipe takes of each column.
BASIC_STATS = ("mean", "min", "max", "sum", "var")
# From this many aggregates on, the combined row is much wider than the rows it combines.
WIDE = 24
# Functions that hold the values of a group in one task.
EXACT = ("median", "iqr")


def cross_specs(columns: Iterable[str], fns: Iterable[str] = BASIC_STATS) -> list[Spec]:
    """Every (column, function) pair of two lists."""
    return [(column, fn) for fn, column in product(fns, columns)]


def recipe_columns(
    specs: Iterable[Spec], name: str, keys: Sequence[str] = (), where: Column | None = None
) -> list[Column]:
    """One aliased aggregate per pair; ``name`` may use {keys}, {fn} and {col}."""
    joined = "_".join(keys)
    return [
        aggregate(fn, column, where).alias(name.format(keys=joined, fn=fn, col=column))
        for column, fn in specs
    ]


def recipe_agg(
    df: DataFrame | Clustered,
    keys: Sequence[str],
    specs: Iterable[Spec] = (),
    name: str = "{keys}_{fn}_{col}",
    where: Column | None = None,
    extra: Iterable[Column] = (),
    hot_rows: int = HOT_ROWS,
    keys_from: DataFrame | Clustered | None = None,
) -> DataFrame:
    """One row per non-NULL key with every pair of the recipe plus ``extra`` aggregates.

    All of them sit in one aggregate after one shuffle. A narrow recipe is combined before the
    shuffle; a wide one shuffles the rows instead and treats hot keys apart (see ``skew``). Medians and
    quartile ranges hold a group's values in one task, so those of hot keys are ranked across tasks
    (see ``quantiles``) and joined on.
    """
    specs, extra = list(specs), list(extra)
    columns = [*recipe_columns(specs, name, keys, where), *extra]

    def build(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(*columns)

    if any(fn in EXACT for _, fn in specs):
        return by_key(df, keys, build, hot_rows, keys_from, lambda rows: _of_hot_keys(rows, keys, specs, name, where, extra))
    if len(columns) < WIDE and not isinstance(df, Clustered):
        return build(not_null_keys(df, keys))
    return by_key(df, keys, build, hot_rows, keys_from)


def distinct_counts(
    df: DataFrame | Clustered, keys: Sequence[str], column: str, outputs: dict[str, Column | None]
) -> DataFrame:
    """Distinct non-NULL values of one column per key, overall (None) or under conditions.

    Grouping by (key, value) first makes each value one row with 0/1 marks, so any number of
    conditions needs no row expansion and a frequent key is spread over its values. A condition
    no row of the key satisfies gives NULL.
    """
    if isinstance(df, Clustered):
        return by_key(df, keys, lambda rows: distinct_counts(rows, keys, column, outputs))
    marks = [
        F.max(F.lit(1) if cond is None else F.when(cond, 1)).cast("long").alias(out)
        for out, cond in outputs.items()
    ]
    per_value = not_null_keys(df, keys).groupBy(*keys, column).agg(*marks)
    counted = [
        F.when(F.max(field(out)) == 1, F.count(F.when(field(out) == 1, field(column)))).alias(out)
        for out in outputs
    ]
    return per_value.groupBy(*keys).agg(*counted)


def _of_hot_keys(
    df: DataFrame, keys: Sequence[str], specs: Sequence[Spec], name: str, where: Column | None, extra: Sequence[Column]
) -> DataFrame:
    """The same columns for groups of any size: medians and quartile ranges are ranked across tasks."""
    keys = list(keys)
    columns = sorted({column for column, fn in specs if fn in EXACT})
    rows = F.lit(True) if where is None else where
    inputs = df.select(
        *[field(k) for k in keys], *[F.when(rows, field(c)).alias(f"_q{i}") for i, c in enumerate(columns)]
    )
    # A quartile range is NULL where a value of the group is missing.
    complete = [
        (F.count(F.when(rows, field(c))) == F.count(F.when(rows, 1))).alias(f"_all{i}") for i, c in enumerate(columns)
    ]
    plain = recipe_columns([s for s in specs if s[1] not in EXACT], name, keys, where)
    stats = df.groupBy(*keys).agg(*plain, *extra, *complete)
    points = quantiles_across_tasks(inputs, keys, [f"_q{i}" for i in range(len(columns))], (0.25, 0.5, 0.75))
    out = []
    for column, fn in specs:
        output = name.format(keys="_".join(keys), fn=fn, col=column)
        if fn not in EXACT:
            out.append(field(output))
            continue
        i = columns.index(column)
        q = F.col(f"_q{i}")
        value = q[1] if fn == "median" else F.when(F.col(f"_all{i}"), drop_nan(q[2] - q[0]))
        out.append(value.alias(output))
    own = len(keys) + len(plain)
    others = [field(c) for c in stats.columns[own : own + len(extra)]]
    return stats.join(points, keys, "left").select(*keys, *out, *others)
