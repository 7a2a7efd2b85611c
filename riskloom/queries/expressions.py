"""Scalar expressions, filters and projections over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.scalars import (
    band_flag, contains_flag, days_between, field, flag, null_below, null_if, null_if_in, ratio,
    row_reduce, tri_flag, weighted_sum,
)
from riskloom.operators.profile import (
    numeric_columns, preview as first_rows, string_columns, table_shape as shape,
    value_counts as frequencies,
)
from riskloom.queries.registry import query, stable, stable_sql, table


@query(
    """
    SELECT l_orderkey, l_linenumber, NULLIF(l_discount, 0) AS discount,
           CASE WHEN l_returnflag NOT IN ('A', 'R') THEN l_returnflag END AS returnflag,
           NULLIF(l_linestatus, 'O') AS linestatus,
           CASE WHEN l_extendedprice >= 10000 THEN l_extendedprice END AS price
    FROM lineitem
    """
)
def null_sentinels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        null_if("l_discount", 0.0).alias("discount"),
        null_if_in("l_returnflag", ["A", "R"]).alias("returnflag"),
        null_if("l_linestatus", "O").alias("linestatus"),
        null_below("l_extendedprice", 10000).alias("price"),
    )


@query(
    f"""
    SELECT l_orderkey, l_linenumber,
           CASE WHEN l_discount = 0 THEN 1 ELSE 0 END AS is_infinite,
           {stable_sql("CASE WHEN l_discount <> 0 THEN l_extendedprice / l_discount END")} AS finite,
           CASE WHEN l_tax = 0 AND l_discount < l_tax THEN 1 ELSE 0 END AS is_negative_infinite,
           CASE WHEN l_tax = 0 AND l_discount = 0 THEN 1 ELSE 0 END AS is_missing,
           {stable_sql("l_extendedprice / NULLIF(l_tax, 0)")} AS per_tax,
           {stable_sql("l_extendedprice / (1 + l_discount)")} AS per_shifted
    FROM lineitem
    """
)
def safe_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_discount = ratio("l_extendedprice", "l_discount")
    signed = ratio(field("l_discount") - field("l_tax"), "l_tax")
    inf = float("inf")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        flag(by_discount == inf).alias("is_infinite"),
        stable(F.when(by_discount < inf, by_discount)).alias("finite"),
        flag(signed == -inf).alias("is_negative_infinite"),
        flag(signed.isNull()).alias("is_missing"),
        stable(ratio("l_extendedprice", "l_tax", on_zero="null")).alias("per_tax"),
        stable(ratio("l_extendedprice", F.lit(1) + field("l_discount"))).alias("per_shifted"),
    )


@query(
    f"""
    SELECT l_orderkey, l_linenumber,
           {stable_sql("l_extendedprice * (1 - l_discount) * (1 + l_tax) - l_extendedprice")} AS difference,
           {stable_sql("2 * l_discount + 3 * l_tax + 4 * l_quantity")} AS weighted,
           CAST(datediff('day', o_orderdate, l_shipdate) AS INTEGER) AS days_to_ship,
           {stable_sql("datediff('day', l_shipdate, o_orderdate) / 30")} AS months_to_ship,
           -l_quantity AS negated
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    """
)
def arithmetic_and_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    paid = field("l_extendedprice") * (1 - field("l_discount")) * (1 + field("l_tax"))
    return joined.select(
        "l_orderkey",
        "l_linenumber",
        stable(paid - field("l_extendedprice")).alias("difference"),
        stable(weighted_sum({"l_discount": 2, "l_tax": 3, "l_quantity": 4})).alias("weighted"),
        days_between("o_orderdate", "l_shipdate").alias("days_to_ship"),
        stable(ratio(days_between("l_shipdate", "o_orderdate"), F.lit(30))).alias("months_to_ship"),
        (-field("l_quantity")).alias("negated"),
    )


@query(
    """
    SELECT p_partkey,
           CASE WHEN NULLIF(p_size, 7) < 20 THEN 1 ELSE 0 END AS small,
           CASE WHEN p_retailprice > 1000 THEN 1 ELSE 0 END AS dear,
           CASE WHEN p_size * 40 > p_retailprice THEN 1 ELSE 0 END AS size_over_price,
           CASE WHEN p_size > 10 AND p_size <= 30 THEN 1 ELSE 0 END AS middle,
           CASE WHEN NULLIF(p_size, 7) IS NULL THEN NULL WHEN p_size < 25 THEN 1 ELSE 0 END AS under_25
    FROM part
    """
)
def flags_and_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = null_if("p_size", 7)
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        flag(size < 20).alias("small"),
        flag(field("p_retailprice") > 1000).alias("dear"),
        flag(field("p_size") * 40 > field("p_retailprice")).alias("size_over_price"),
        band_flag("p_size", 10, 30).alias("middle"),
        tri_flag(size, F.lit(25)).alias("under_25"),
    )


@query(
    """
    SELECT p_partkey,
           CASE WHEN lower(p_name) LIKE '%ring%' THEN 1 ELSE 0 END AS ring,
           CASE WHEN lower(p_name) LIKE '%red w%' THEN 1 ELSE 0 END AS red_w,
           CASE WHEN p_type = 'PROMO' THEN 0 WHEN lower(p_type) LIKE '%m%' THEN 1 ELSE 0 END AS m_default,
           CASE WHEN p_type = 'PROMO' OR lower(p_type) LIKE '%m%' THEN 1 ELSE 0 END AS m_null_as_one
    FROM part
    """
)
def contains_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = null_if("p_type", "PROMO")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        contains_flag("p_name", "RING").alias("ring"),
        contains_flag("p_name", "Red W").alias("red_w"),
        contains_flag(kind, "m").alias("m_default"),
        contains_flag(kind, "M", null_as=1).alias("m_null_as_one"),
    )


@query(
    f"""
    WITH c AS (
        SELECT l_orderkey, l_linenumber, NULLIF(l_discount, 0) AS a, NULLIF(l_tax, 0) AS b,
               CASE WHEN l_quantity >= 10 THEN l_quantity END AS d, l_discount, l_tax
        FROM lineitem
    )
    SELECT l_orderkey, l_linenumber, least(a, b, d) AS r_min, greatest(a, b, d) AS r_max,
           {stable_sql("coalesce(a, 0) + coalesce(b, 0) + coalesce(d, 0)")} AS r_sum,
           {stable_sql("list_aggregate([a, b, d], 'avg')")} AS r_mean,
           {stable_sql("list_aggregate([a, b, d], 'median')")} AS r_median,
           {stable_sql("abs(l_discount - l_tax)")} AS gap
    FROM c
    """
)
def row_reductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = [null_if("l_discount", 0.0), null_if("l_tax", 0.0), null_below("l_quantity", 10)]
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        row_reduce(cols, "min").alias("r_min"),
        row_reduce(cols, "max").alias("r_max"),
        *[stable(row_reduce(cols, fn)).alias(f"r_{fn}") for fn in ("sum", "mean", "median")],
        stable(F.abs(field("l_discount") - field("l_tax"))).alias("gap"),
    )


@query(
    """
    SELECT l_orderkey, l_linenumber, l_quantity, NULLIF(l_tax, 0.04) AS tax
    FROM lineitem
    WHERE l_shipdate < TIMESTAMP '1998-01-01' AND l_quantity > 25
      AND (NULLIF(l_tax, 0.04) IS NULL OR l_tax <> 0)
    """
)
def filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("tax", null_if("l_tax", 0.04))
    before = field("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    # A missing value is "not equal to zero" in a filter, so NULL is let through by name.
    kept = lines.where(before & (field("l_quantity") > 25)).where(
        field("tax").isNull() | (field("tax") != 0)
    )
    return kept.select("l_orderkey", "l_linenumber", "l_quantity", "tax")


@query(
    """
    SELECT o_orderkey AS order_id, o_orderstatus AS "status-code",
           CAST(floor(o_totalprice) AS BIGINT) AS whole_price,
           coalesce(CAST(NULLIF(o_custkey, 7) AS VARCHAR), 'nan') AS customer_text
    FROM orders
    """
)
def project_rename_drop_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").drop("o_orderdate", "o_orderpriority")
    renamed = orders.withColumnsRenamed({"o_orderkey": "order_id", "o_orderstatus": "status-code"})
    customer = null_if("o_custkey", 7).cast("string")
    return renamed.select(
        "order_id",
        field("status-code"),
        F.floor("o_totalprice").alias("whole_price"),
        F.coalesce(customer, F.lit("nan")).alias("customer_text"),
    )


@query(
    """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
           l_returnflag, l_linestatus
    FROM lineitem
    """
)
def columns_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    numbers = numeric_columns(lines, exclude=["l_orderkey"])
    return lines.select("l_orderkey", *numbers, *string_columns(lines))


@query(
    """
    SELECT NULLIF(o_orderpriority, '5-LOW') AS priority, count(*) AS n FROM orders
    WHERE NULLIF(o_orderpriority, '5-LOW') IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1
    """
)
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return frequencies(orders.select(null_if("o_orderpriority", "5-LOW").alias("priority")), "priority")


@query("SELECT count(*) AS n_rows, CAST(6 AS BIGINT) AS n_columns FROM orders")
def table_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape(table(spark, sf_dir, "orders"))


@query(
    """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders
    ORDER BY o_totalprice DESC, o_orderkey LIMIT 20
    """
)
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
    return first_rows(orders.select(*columns), 20, [F.desc("o_totalprice"), "o_orderkey"])
