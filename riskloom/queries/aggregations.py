"""Joins, recipe aggregation, group statistics, pivots, latest rows and last-k."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.aggregates import aggregate
from riskloom.functions.scalars import days_between, field, flag, null_if, ratio
from riskloom.operators.groupstats import GroupStats, Recipe
from riskloom.operators.joins import attach, key_spine, prefixed
from riskloom.operators.latest import (
    last_k, last_k_agg, last_k_apply, latest_one, latest_rows, with_group_stat,
)
from riskloom.operators.pivot import first_occurrence_columns, pivot_columns
from riskloom.operators.quantiles import group_quantiles
from riskloom.operators.recipe import cross_specs, distinct_counts, recipe_agg
from riskloom.queries.registry import query, stabilise, stable, stable_sql, table

S = stable_sql


@query(
    f"""
    SELECT k.custkey, c_acctbal, n_orders, {S("total")} AS total, {S("total / NULLIF(c_acctbal, 0)")} AS per_balance
    FROM (SELECT c_custkey AS custkey FROM customer UNION SELECT o_custkey FROM orders
          UNION SELECT user_id FROM events) k
    LEFT JOIN customer ON c_custkey = custkey
    LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, sum(o_totalprice) AS total FROM orders GROUP BY 1)
      ON o_custkey = custkey
    """
)
def left_join_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "custkey")
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "custkey")
    users = table(spark, sf_dir, "events").withColumnRenamed("user_id", "custkey")
    totals = recipe_agg(
        orders,
        ["custkey"],
        extra=[aggregate("size", "custkey").alias("n_orders"), aggregate("sum", "o_totalprice").alias("total")],
    )
    spine = key_spine(["custkey"], customers, orders, users)
    joined = attach(spine, customers.select("custkey", "c_acctbal"), totals, on=["custkey"])
    return joined.select(
        "custkey",
        "c_acctbal",
        "n_orders",
        stable("total").alias("total"),
        stable(ratio("total", "c_acctbal", on_zero="null")).alias("per_balance"),
    )


@query(
    """
    SELECT l_partkey, l_suppkey, n_lines, n_returned, max_quantity
    FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
    LEFT JOIN (SELECT l_partkey, l_suppkey, count(*) AS n_lines, max(l_quantity) AS max_quantity
               FROM lineitem GROUP BY 1, 2) USING (l_partkey, l_suppkey)
    LEFT JOIN (SELECT l_partkey, l_suppkey, count(*) AS n_returned FROM lineitem
               WHERE l_returnflag = 'R' GROUP BY 1, 2) USING (l_partkey, l_suppkey)
    """
)
def composite_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    pair = ["l_partkey", "l_suppkey"]
    every = recipe_agg(
        lines, pair, extra=[F.count(F.lit(1)).alias("n_lines"), F.max("l_quantity").alias("max_quantity")]
    )
    returned = recipe_agg(
        lines.where(field("l_returnflag") == "R"), pair, extra=[F.count(F.lit(1)).alias("n_returned")]
    )
    return attach(key_spine(pair, lines), every, returned, on=pair)


_CUSTOMER_RECIPES = (
    Recipe(("segment", "c_nationkey"), (("c_acctbal", "mean"), ("c_acctbal", "max"))),
    Recipe(("segment",), (("c_acctbal", "min"), ("c_acctbal", "sum"), ("c_acctbal", "count"))),
)
_CUSTOMERS_SQL = """
    c AS (SELECT c_custkey, NULLIF(c_mktsegment, 'BUILDING') AS segment, c_nationkey, c_acctbal FROM customer)
"""


def _group_stats_sql(rows: str) -> str:
    """SQL of the statistics in _CUSTOMER_RECIPES fitted on ``rows``."""
    return f"""
    two AS (SELECT segment, c_nationkey, avg(c_acctbal) AS m, max(c_acctbal) AS x FROM {rows} GROUP BY 1, 2),
    one AS (SELECT segment, min(c_acctbal) AS lo, sum(c_acctbal) AS s, count(c_acctbal) AS n
            FROM {rows} GROUP BY 1),
    j AS (SELECT c.*, m, x, lo, s, n FROM c
          LEFT JOIN two ON c.segment = two.segment AND c.c_nationkey = two.c_nationkey
          LEFT JOIN one ON c.segment = one.segment)
    SELECT c_custkey, segment, c_nationkey, c_acctbal,
           {S("m")} AS segment_c_nationkey_mean_c_acctbal, x AS segment_c_nationkey_max_c_acctbal,
           lo AS segment_min_c_acctbal, {S("s")} AS segment_sum_c_acctbal, n AS segment_count_c_acctbal
    """


def _segmented_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    return customers.select(
        "c_custkey", null_if("c_mktsegment", "BUILDING").alias("segment"), "c_nationkey", "c_acctbal"
    )


def _customer_statistics(df: DataFrame) -> DataFrame:
    sums = ["segment_c_nationkey_mean_c_acctbal", "segment_sum_c_acctbal"]
    return df.withColumns({c: stable(c) for c in sums})


@query(f"WITH {_CUSTOMERS_SQL}, {_group_stats_sql('c')} FROM j")
def group_stats_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _segmented_customers(spark, sf_dir)
    stats = GroupStats.fit(customers, _CUSTOMER_RECIPES)
    return _customer_statistics(stats.transform(customers, deviations=False))


@query(
    f"""WITH {_CUSTOMERS_SQL}, {_group_stats_sql('c')},
    {S("c_acctbal - m")} AS segment_c_nationkey_mean_c_acctbal_diff,
    {S("abs(c_acctbal - m)")} AS segment_c_nationkey_mean_c_acctbal_abs_diff,
    {S("c_acctbal - x")} AS segment_c_nationkey_max_c_acctbal_diff,
    {S("abs(c_acctbal - x)")} AS segment_c_nationkey_max_c_acctbal_abs_diff,
    {S("c_acctbal - lo")} AS segment_min_c_acctbal_diff,
    {S("abs(c_acctbal - lo)")} AS segment_min_c_acctbal_abs_diff FROM j"""
)
def group_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _segmented_customers(spark, sf_dir)
    # A broadcast limit of no rows takes the shuffle join, which must give the same result.
    stats = GroupStats.fit(customers, _CUSTOMER_RECIPES, broadcast_rows=0)
    wide = stats.transform(customers)
    gaps = [c for c in wide.columns if c.endswith("_diff")]
    return _customer_statistics(wide).withColumns({c: stable(c) for c in gaps})


_MEDIANS = (
    Recipe(("segment", "c_nationkey"), (("c_acctbal", "median"), ("c_acctbal", "count"))),
    Recipe(("segment",), (("c_acctbal", "median"), ("c_custkey", "median"), ("c_acctbal", "max"))),
    Recipe(("c_nationkey",), (("c_acctbal", "median"),)),
)


def _median_sql() -> str:
    tables, joins, columns = [], [], []
    for i, recipe in enumerate(_MEDIANS):
        keys = ", ".join(recipe.keys)
        complete = " AND ".join(f"{k} IS NOT NULL" for k in recipe.keys)
        values = ", ".join(f"{fn}({c}) AS {out}" for c, fn, out in recipe.outputs)
        tables.append(f"g{i} AS (SELECT {keys}, {values} FROM c WHERE {complete} GROUP BY {keys})")
        joins.append(f"LEFT JOIN g{i} USING ({keys})")
        for c, fn, out in recipe.outputs:
            columns.append(f"{S(out)} AS {out}" if fn == "median" else out)
            if fn != "count":
                columns += [f"{S(f'{c} - {out}')} AS {out}_diff", f"{S(f'abs({c} - {out})')} AS {out}_abs_diff"]
    return f"""WITH {_CUSTOMERS_SQL}, {", ".join(tables)}
    SELECT c_custkey, segment, c_nationkey, c_acctbal, {", ".join(columns)} FROM c {" ".join(joins)}"""


@query(_median_sql())
def group_median_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of three groupings from one count of values, and the distance of each row from them."""
    customers = _segmented_customers(spark, sf_dir)
    wide = GroupStats.fit(customers, _MEDIANS).transform(customers)
    return wide.withColumns({c: stable(c) for c in wide.columns if "median" in c or c.endswith("_diff")})


@query(
    f"""WITH {_CUSTOMERS_SQL}, t AS (SELECT * FROM c WHERE c_custkey % 5 <> 0),
    {_group_stats_sql('t')}, CASE WHEN c_custkey % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM j"""
)
def train_fit_test_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _segmented_customers(spark, sf_dir)
    train = customers.where(field("c_custkey") % 5 != 0)
    test = customers.where(field("c_custkey") % 5 == 0)
    stats = GroupStats.fit(train, _CUSTOMER_RECIPES)
    train, test = stats.transform(train, deviations=False), stats.transform(test, deviations=False)
    return _customer_statistics(
        train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    )


@query(
    f"""
    SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'test' ELSE 'train' END AS split,
           orders__n, {S("orders__mean")} AS orders__mean, events__n, {S("events__mean")} AS events__mean
    FROM customer
    LEFT JOIN (SELECT o_custkey, count(*) AS orders__n, avg(o_totalprice) AS orders__mean FROM orders GROUP BY 1)
      ON o_custkey = c_custkey
    LEFT JOIN (SELECT user_id, count(*) AS events__n, avg(value) AS events__mean FROM events GROUP BY 1)
      ON user_id = c_custkey
    """
)
def agg_to_both_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    def features(name: str, key: str, column: str) -> DataFrame:
        rows = table(spark, sf_dir, name).withColumnRenamed(key, "c_custkey")
        stats = [F.count(F.lit(1)).alias("n"), aggregate("mean", column).alias("mean")]
        return prefixed(recipe_agg(rows, ["c_custkey"], extra=stats), f"{name}__", ["c_custkey"])

    customers = table(spark, sf_dir, "customer").select("c_custkey")
    split = F.when(field("c_custkey") % 5 == 0, "test").otherwise("train")
    # Aggregated once; train and test are two values of one column, not two joins.
    return stabilise(
        attach(
            customers.withColumn("split", split),
            features("orders", "o_custkey", "o_totalprice"),
            features("events", "user_id", "value"),
            on=["c_custkey"],
        )
    )


@query(
    f"""
    SELECT o_custkey, count(*) AS o_custkey_size_o_totalprice, count(status) AS o_custkey_count_status,
           count(DISTINCT status) AS o_custkey_nunique_status,
           {S("avg(price)")} AS o_custkey_mean_price, {S("min(price)")} AS o_custkey_min_price,
           {S("max(price)")} AS o_custkey_max_price, {S("coalesce(sum(price), 0)")} AS o_custkey_sum_price,
           {S("var_samp(price)")} AS o_custkey_var_price
    FROM (SELECT o_custkey, o_totalprice, NULLIF(o_orderstatus, 'P') AS status,
                 CASE WHEN o_totalprice >= 100000 THEN o_totalprice END AS price FROM orders)
    GROUP BY 1
    """
)
def recipe_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumns(
        {
            "status": null_if("o_orderstatus", "P"),
            "price": F.when(field("o_totalprice") >= 100000, field("o_totalprice")),
        }
    )
    specs = [("o_totalprice", "size"), ("status", "count"), ("status", "nunique"), *cross_specs(["price"])]
    return stabilise(recipe_agg(orders, ["o_custkey"], specs))


@query(
    f"""
    SELECT user_id, {S("stddev_samp(value)")} AS std_value, {S("skewness(value)")} AS skew_value,
           {S("skewness(value) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1))")} AS skew_pop_value,
           {S("kurtosis_pop(value)")} AS kurt_value, {S("median(value)")} AS median_value,
           {S("quantile_cont(value, 0.75) - quantile_cont(value, 0.25)")} AS iqr_value
    FROM events GROUP BY 1
    """
)
def recipe_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    specs = [("value", fn) for fn in ("std", "skew", "skew_pop", "kurt")]
    moments = recipe_agg(events, ["user_id"], specs, "{fn}_{col}")
    quartiles = group_quantiles(events, ["user_id"], ["value"], (0.25, 0.5, 0.75))
    joined = moments.join(quartiles, "user_id", "left")
    points = field("value")
    exact = {"median_value": points[1], "iqr_value": points[2] - points[0]}
    return stabilise(joined.withColumns(exact).drop("value"))


@query(
    f"""
    SELECT l_returnflag, l_linestatus, {S("quantile_cont(l_extendedprice, 0.25)")} AS price_p25,
           {S("median(l_extendedprice)")} AS price_median,
           {S("quantile_cont(l_extendedprice, 0.99)")} AS price_p99,
           {S("median(l_quantity)")} AS quantity_median
    FROM lineitem GROUP BY 1, 2
    """
)
def quantiles_of_large_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Each group holds a sixth of the table; the low limit ranks them all across tasks.
    lines = table(spark, sf_dir, "lineitem")
    keys = ["l_returnflag", "l_linestatus"]
    columns = ["l_extendedprice", "l_quantity"]
    found = group_quantiles(lines, keys, columns, (0.25, 0.5, 0.99), hot_rows=100)
    price, quantity = field("l_extendedprice"), field("l_quantity")
    return found.select(
        *keys,
        stable(price[0]).alias("price_p25"),
        stable(price[1]).alias("price_median"),
        stable(price[2]).alias("price_p99"),
        stable(quantity[1]).alias("quantity_median"),
    )


@query(
    f"""
    SELECT user_id, {S("avg(CASE WHEN value > 20 THEN 1 ELSE 0 END)")} AS share_high,
           {S("avg(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)")} AS share_error
    FROM events GROUP BY 1
    """
)
def flag_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumns(
        {"high": flag(field("value") > 20), "error": flag(field("event_type") == "error")}
    )
    return stabilise(recipe_agg(events, ["user_id"], [("high", "mean"), ("error", "mean")], "share_{col}"))


_PAYMENTS_SQL = """
    p AS (
        SELECT l_orderkey, l_linenumber, l_quantity, NULLIF(l_tax, 0.04) AS paid,
               datediff('day', l_shipdate, o_orderdate) AS days, NULLIF(l_tax, 0.04) - l_discount AS amount
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    )
"""


def _payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    paid = null_if("l_tax", 0.04)
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        paid.alias("paid"),
        days_between("l_shipdate", "o_orderdate").alias("days"),
        (paid - field("l_discount")).alias("amount"),
    )


@query(
    f"""
    WITH {_PAYMENTS_SQL}
    SELECT l_orderkey,
           NULLIF(count(*) FILTER (WHERE days < 0 AND (paid IS NULL OR paid <> 0)), 0) AS number_late,
           min(l_linenumber) FILTER (WHERE days < 0 AND (paid IS NULL OR paid <> 0)) AS first_late,
           max(l_linenumber) FILTER (WHERE days > 0 AND (paid IS NULL OR paid <> 0)) AS last_early,
           {S("sum(amount) FILTER (WHERE amount > 0 AND paid <> 0)")} AS sum_high,
           {S("avg(amount) FILTER (WHERE amount < 0 AND paid <> 0)")} AS mean_low,
           {S("min(amount) FILTER (WHERE amount < 0 AND paid <> 0)")} AS max_low
    FROM p GROUP BY 1
    """
)
def conditional_aggs(spark: SparkSession, sf_dir: str) -> DataFrame:
    paid = field("paid").isNull() | (field("paid") != 0)
    late, early = (field("days") < 0) & paid, (field("days") > 0) & paid
    high, low = (field("amount") > 0) & paid, (field("amount") < 0) & paid
    columns = [
        aggregate("size", "days", late).alias("number_late"),
        aggregate("min", "l_linenumber", late).alias("first_late"),
        aggregate("max", "l_linenumber", early).alias("last_early"),
        aggregate("sum", "amount", high).alias("sum_high"),
        aggregate("mean", "amount", low).alias("mean_low"),
        aggregate("min", "amount", low).alias("max_low"),
    ]
    return stabilise(recipe_agg(_payments(spark, sf_dir), ["l_orderkey"], extra=columns))


@query(
    """
    SELECT l_suppkey, count(DISTINCT l_partkey) AS n_parts,
           NULLIF(count(DISTINCT l_partkey) FILTER (WHERE l_returnflag = 'R'), 0) AS n_returned_parts,
           NULLIF(count(DISTINCT l_partkey) FILTER (WHERE l_quantity > 49), 0) AS n_bulk_parts
    FROM lineitem GROUP BY 1
    """
)
def conditional_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    outputs = {
        "n_parts": None,
        "n_returned_parts": field("l_returnflag") == "R",
        "n_bulk_parts": field("l_quantity") > 49,
    }
    return distinct_counts(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_partkey", outputs)


@query(
    f"""
    WITH per_order AS (
        SELECT o_custkey, o_orderkey, max(l_linenumber) AS lines, max(l_extendedprice) / max(l_quantity) AS peak
        FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2
    )
    SELECT o_custkey, count(*) AS n_orders, CAST(coalesce(sum(lines), 0) AS BIGINT) AS total_lines,
           {S("avg(peak)")} AS mean_peak, {S("coalesce(sum(lines), 0) / count(*)")} AS lines_per_order
    FROM per_order GROUP BY 1
    """
)
def two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    per_order = recipe_agg(
        lines,
        ["o_orderkey"],
        extra=[
            F.max("l_linenumber").alias("lines"),
            ratio(F.max("l_extendedprice"), F.max("l_quantity")).alias("peak"),
        ],
    )
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    per_customer = recipe_agg(
        attach(orders, per_order, on=["o_orderkey"]),
        ["o_custkey"],
        extra=[
            aggregate("size", "lines").alias("n_orders"),
            aggregate("sum", "lines").alias("total_lines"),
            aggregate("mean", "peak").alias("mean_peak"),
        ],
    )
    return stabilise(per_customer.withColumn("lines_per_order", ratio("total_lines", "n_orders")))


_STATUS = {"F": "F", "O": "O", "P": "P", "Z": "Z"}


def _named(prefix: str) -> dict[str, str]:
    return {value: f"{prefix}_{name}" for value, name in _STATUS.items()}


@query(
    """
    SELECT o_custkey, NULLIF(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS n_F,
           NULLIF(count(*) FILTER (WHERE o_orderstatus = 'O'), 0) AS n_O,
           NULLIF(count(*) FILTER (WHERE o_orderstatus = 'P'), 0) AS n_P,
           NULLIF(count(*) FILTER (WHERE o_orderstatus = 'Z'), 0) AS n_Z
    FROM orders GROUP BY 1
    """
)
def pivot_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = pivot_columns("o_orderstatus", _named("n"), "count", "o_orderkey")
    return recipe_agg(table(spark, sf_dir, "orders"), ["o_custkey"], extra=columns)


@query(
    "SELECT o_custkey, "
    + ", ".join(
        S(
            f"CASE WHEN count(*) FILTER (WHERE o_orderstatus = '{s}') > 0 THEN coalesce(sum(o_totalprice) "
            f"FILTER (WHERE o_orderstatus = '{s}' AND o_totalprice > 200000), 0) END"
        )
        + f" AS total_{s}"
        for s in _STATUS
    )
    + " FROM orders GROUP BY 1"
)
def pivot_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    dear = F.when(field("o_totalprice") > 200000, field("o_totalprice"))
    columns = pivot_columns("o_orderstatus", _named("total"), "sum", dear)
    return stabilise(recipe_agg(table(spark, sf_dir, "orders"), ["o_custkey"], extra=columns))


@query(
    "SELECT o_custkey, "
    + ", ".join(f"min(o_totalprice) FILTER (WHERE o_orderstatus = '{s}') AS least_{s}" for s in _STATUS)
    + " FROM orders GROUP BY 1"
)
def pivot_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = pivot_columns("o_orderstatus", _named("least"), "min", "o_totalprice")
    return recipe_agg(table(spark, sf_dir, "orders"), ["o_custkey"], extra=columns)


@query(
    "SELECT o_custkey, "
    + ", ".join(
        f"NULLIF(count(*) FILTER (WHERE o_orderstatus = '{s}' AND o_orderdate < TIMESTAMP '1997-01-01'), 0) AS past_{s}"
        for s in _STATUS
    )
    + " FROM orders GROUP BY 1"
)
def pivot_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    past = field("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz")
    columns = pivot_columns("o_orderstatus", _named("past"), "count", "o_orderkey", where=past)
    return recipe_agg(table(spark, sf_dir, "orders"), ["o_custkey"], extra=columns)


@query(
    "SELECT l_orderkey, "
    + ", ".join(
        f"min(l_linenumber) FILTER (WHERE l_returnflag = '{s}') - min(l_linenumber) + 1 AS first_{s}"
        for s in ("A", "N", "R")
    )
    + " FROM lineitem GROUP BY 1"
)
def first_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {s: f"first_{s}" for s in ("A", "N", "R")}
    columns = first_occurrence_columns("l_returnflag", names, "l_linenumber")
    return recipe_agg(table(spark, sf_dir, "lineitem"), ["l_orderkey"], extra=columns)


@query(
    """
    SELECT o_custkey, o_orderkey, o_totalprice, max(o_totalprice) OVER (PARTITION BY o_custkey) AS top_price
    FROM orders
    """
)
def group_max_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return with_group_stat(orders, ["o_custkey"], "o_totalprice", "max", "top_price")


@query(
    """
    SELECT l_orderkey, flag, l_quantity,
           CASE WHEN flag IS NOT NULL THEN max(l_quantity) OVER (PARTITION BY flag) END AS top_quantity
    FROM (SELECT l_orderkey, NULLIF(l_returnflag, 'N') AS flag, l_quantity FROM lineitem)
    """
)
def group_max_of_large_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Two groups and the missing key hold a third of the table each.
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", null_if("l_returnflag", "N").alias("flag"), "l_quantity"
    )
    return with_group_stat(lines, ["flag"], "l_quantity", "max", "top_quantity", hot_rows=100)


@query(
    """
    SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority FROM orders
    QUALIFY rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) = 1
    """
)
def latest_ties_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = latest_rows(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate")
    return newest.select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")


@query(
    """
    SELECT o_custkey, o_orderstatus AS latest_status, o_orderpriority AS latest_priority FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
    """
)
def latest_ties_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {"o_orderstatus": "latest_status", "o_orderpriority": "latest_priority"}
    orders = table(spark, sf_dir, "orders")
    return latest_one(orders, ["o_custkey"], "o_orderdate", columns, tie_break=["o_orderkey"])


@query(
    """
    SELECT user_id, event_id, value, rn AS event_rank FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
    WHERE rn <= 10
    """
)
def last_k_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    rows = last_k(events, ["user_id"], "ts", 10, ["event_id"], rank="event_rank")
    return rows.select("user_id", "event_id", "value", F.col("event_rank").cast("long").alias("event_rank"))


_KS = (1, 5, 10, 20, 50, 100)
_LAST_FNS = ("sum", "mean", "max", "min", "std", "count", "median", "skew", "kurt", "iqr")


def _last_k_sql(k: int, column: str) -> list[str]:
    c = f"CASE WHEN rn <= {k} THEN {column} END"
    n = f"count({c})"
    constant = f"min({c}) = max({c})"
    population = f"skewness({c}) * ({n} - 2) / sqrt({n} * ({n} - 1))"
    # The adjusted coefficient does not exist for two values, the population one is 0 there.
    skew = f"CASE WHEN {constant} THEN NULL WHEN {n} = 2 THEN 0 ELSE {population} END"
    values = {
        "sum": f"coalesce(sum({c}), 0)",
        "mean": f"avg({c})",
        "max": f"max({c})",
        "min": f"min({c})",
        "std": f"stddev_samp({c})",
        "median": f"median({c})",
        "skew": skew,
        "kurt": f"CASE WHEN NOT ({constant}) THEN kurtosis_pop({c}) END",
        "iqr": f"quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)",
    }
    columns = [f"{S(v)} AS last_{k}_{column}_{fn}" for fn, v in values.items()]
    return [*columns, f"{n} AS last_{k}_{column}_count"]


@query(
    "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn "
    "FROM events) SELECT user_id, "
    + ", ".join(text for k in _KS for text in _last_k_sql(k, "value"))
    + " FROM r GROUP BY 1"
)
def last_k_aggs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    specs = [("value", fn) for fn in _LAST_FNS]
    fns = {"skew": "skew_pop"}
    return stabilise(last_k_agg(events, ["user_id"], "ts", specs, _KS, ["event_id"], fns=fns))


@query(
    f"""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events),
    d AS (SELECT *, value - lead(value) OVER (PARTITION BY user_id ORDER BY rn) AS step FROM r WHERE rn <= 20)
    SELECT user_id, count(*) AS n, {S("max(abs(step))")} AS largest_step, {S("sum(value / rn)")} AS faded
    FROM d GROUP BY 1
    """
)
def grouped_map_last_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    def steps(group: pd.DataFrame) -> pd.DataFrame:
        value = group["value"].reset_index(drop=True)
        return pd.DataFrame(
            {
                "user_id": [group["user_id"].iloc[0]],
                "n": [len(value)],
                "largest_step": [value.diff().abs().max()],
                "faded": [(value / (value.index + 1)).sum()],
            }
        )

    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    schema = "user_id long, n long, largest_step double, faded double"
    return stabilise(last_k_apply(events, ["user_id"], "ts", 20, steps, schema, ["event_id"]))
