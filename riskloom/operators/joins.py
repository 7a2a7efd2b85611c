"""Left joins onto a spine of keys, and statistics joined back to their member rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.scalars import field, quoted
from riskloom.sources.tables import stage

# A key is hot above this many rows.
HOT_ROWS = 1_000_000
# Rows without a key are spread over this many slots when they must be shuffled, or over eight
# for each shuffle partition if that is more.
SPREAD_SLOTS = 512
# Classes of keys that share a number of salts.
SALT_CLASSES = 8_192


def key_spine(keys: Sequence[str], *tables: DataFrame) -> DataFrame:
    """Distinct keys over all tables, one shuffle."""
    return reduce(DataFrame.unionByName, [t.select(*keys) for t in tables]).distinct()


def _no_clash(spine: DataFrame, features: Sequence[DataFrame], on: Sequence[str]) -> None:
    seen = set(spine.columns)
    for table in features:
        clash = seen.intersection(set(table.columns) - set(on))
        if clash:
            raise ValueError(f"duplicate feature columns: {sorted(clash)}")
        seen.update(table.columns)


def attach(spine: DataFrame, *features: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left-join feature tables (one row per key) to the spine; row count is unchanged.

    A column name offered twice raises at once instead of becoming ambiguous later.
    """
    on = list(on)
    _no_clash(spine, features, on)
    return reduce(lambda left, right: left.join(right, on, "left"), features, spine)


def attach_packed(
    spine: DataFrame,
    *features: DataFrame,
    on: Sequence[str],
    inputs: Sequence[str] = (),
    derive: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """``derive(attach(...))`` for wide tables, with the same columns and types.

    On their way through the joins the columns of a table that have one type lie in one array. A join copies it as a whole;
    a join of flat tables writes every column by code of its own, and a thousand columns of that at each join are more code
    than the JVM gets to compile. ``derive`` adds columns to those it is shown, which are the keys and ``inputs``.
    """
    on, places = list(on), {}
    _no_clash(spine, features, on)

    def packed(i: int, table: DataFrame) -> DataFrame:
        by_type: dict[str, list[str]] = {}
        for f in table.schema.fields:
            if f.name not in on:
                by_type.setdefault(f.dataType.json(), []).append(f.name)
        arrays = []
        for j, names in enumerate(by_type.values()):
            places.update({name: f"get(_{i}_{j}, {at}) AS {quoted(name)}" for at, name in enumerate(names)})
            arrays.append(f"array({', '.join(map(quoted, names))}) AS _{i}_{j}")
        return table.selectExpr(*map(quoted, on), *arrays)

    tables = [packed(i, table) for i, table in enumerate((spine, *features))]
    joined = reduce(lambda left, right: left.join(right, on, "left"), tables)
    shown = joined.selectExpr("*", *[places[c] for c in inputs])
    derived = derive(shown)
    added = [c for c in derived.columns if c not in shown.columns]
    columns = [*spine.columns, *[c for table in features for c in table.columns if c not in on]]
    # Said in SQL, one call for all columns: a Python object for each of a thousand takes longer than the join.
    return derived.selectExpr(*[quoted(c) if c in on or c in inputs else places[c] for c in columns], *map(quoted, added))


def prefixed(df: DataFrame, prefix: str, keep: Sequence[str]) -> DataFrame:
    """Rename every column except the keys with a source prefix."""
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in df.columns if c not in keep})


def _row_key(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[field(k) for k in keys])


def _salt_bits(stats: DataFrame, keys: Sequence[str], count_col: str, hot_rows: int) -> bytes:
    """Binary logarithm of the salts of each class of keys, one byte a class; empty if no key is hot.

    ``SALT_CLASSES`` bytes at most, however many keys are hot.
    """
    most = F.max(field(count_col)) / F.lit(float(max(hot_rows, 1)))
    bits = F.greatest(F.lit(0), F.ceil(F.log2(most))).cast("int")
    classes = stats.groupBy(F.pmod(_row_key(keys), F.lit(SALT_CLASSES)).alias("_class")).agg(bits.alias("_bits"))
    found = classes.where(F.col("_bits") > 0).collect()
    if not found:
        return b""
    table = bytearray(SALT_CLASSES)
    for r in found:
        table[r["_class"]] = r["_bits"]
    return bytes(table)


def join_back(
    rows: DataFrame,
    stats: DataFrame,
    keys: Sequence[str],
    count_col: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Left-join per-key statistics to every member row without piling a hot key on one task.

    ``count_col`` of ``stats`` is the number of rows of the key, which may be an estimate. A key with more than
    ``hot_rows`` rows gets salts, two, four and so on: its statistics are repeated for each, and its rows take one by a hash. Rows
    need to know how many: keys fall into classes by hash, and a class has the salts of its most frequent key,
    so a table of one byte a class serves any number of hot keys and nothing is broadcast. Rows without a complete key
    match nothing and are spread over slots; they get NULLs.
    """
    keys = list(keys)
    outputs = [c for c in stats.columns if c not in (*keys, count_col)]
    stats = stage(stats, "statistics")  # counted below and joined afterwards
    bits = _salt_bits(stats, keys, count_col, hot_rows)
    packed = stats.select(*keys, F.struct(*[field(c) for c in outputs], F.lit(True).alias("_is")).alias("_stats"))
    unkeyed = reduce(lambda a, b: a | b, [field(k).isNull() for k in keys])
    slots = max(SPREAD_SLOTS, 8 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # The partition id spreads identical copies of a row; both parts are the same on a rerun.
    mix = F.xxhash64(F.spark_partition_id(), *[field(c) for c in rows.columns])
    if bits:
        place = F.pmod(_row_key(keys), F.lit(SALT_CLASSES)).cast("int") + 1
        salts = F.pow(F.lit(2), F.conv(F.hex(F.substring(F.lit(bits), place, F.lit(1))), 16, 10)).cast("long")
        salt = F.pmod(mix, salts).cast("int")
        packed = packed.withColumn("_slot", F.explode(F.sequence(F.lit(0), salts.cast("int") - 1)))
    else:
        # Always 0, but written so that the optimizer cannot tell: a constant would be taken out of the
        # join key, and with it the spreading of the rows without a key.
        salt = F.when(unkeyed, 1).otherwise(0)
        packed = packed.withColumn("_slot", F.when(F.col("_stats").isNull(), 1).otherwise(0))
    spread = F.pmod(mix, F.lit(slots)).cast("int")
    salted = rows.withColumn("_slot", F.when(unkeyed, spread).otherwise(salt))
    joined = salted.join(packed, [*keys, "_slot"], "left")
    return joined.select(*[field(c) for c in rows.columns], *[F.col("_stats")[c].alias(c) for c in outputs])
