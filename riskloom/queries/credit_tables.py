"""Credit tables derived from the given tables, as SQL both engines read alike.

Customers play the applicants, orders the external credits and previous applications, order
lines the monthly statuses and instalments, events the point-of-sale and card balances. Every
row of the given tables is used. Sentinels, missing values, zero denominators and absent
categories are placed by arithmetic on the keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.plans.bureau import CREDIT_TYPES
from riskloom.plans.previous import CATEGORY_COUNTS
from riskloom.queries.registry import table

# Day offsets are counted from this application date.
APPLICATION_DATE = "2001-12-31"


def _case(expression: str, values: list[str]) -> str:
    """Value by the remainder ``expression``."""
    return "CASE " + expression + "".join(f" WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def _share(multiplier: int, missing_every: int) -> str:
    return (
        f"CASE WHEN c_custkey % {missing_every} = 1 THEN NULL "
        f"ELSE CAST(c_custkey * {multiplier} % 997 AS DOUBLE) / 997 END"
    )


_APPLICANTS = f"""
    SELECT c_custkey AS SK_ID_CURR,
        CASE WHEN c_custkey % 5 = 0 THEN NULL
             WHEN c_acctbal < 0 OR (c_custkey * 7 + c_nationkey) % 10 < 2 THEN 1 ELSE 0 END AS TARGET,
        CASE WHEN c_custkey % 17 = 0 THEN 'XNA' WHEN c_custkey % 3 = 0 THEN 'M' ELSE 'F' END AS CODE_GENDER,
        CASE WHEN c_custkey % 13 = 0 THEN NULL
             ELSE {_case("c_nationkey % 4", ["Academic", "Higher", "Incomplete", "Secondary"])} END
             AS NAME_EDUCATION_TYPE,
        {_case("c_custkey % 4", ["Commercial", "Pensioner", "State", "Working"])} AS NAME_INCOME_TYPE,
        CASE WHEN c_custkey % 11 < 3 THEN NULL ELSE c_mktsegment END AS OCCUPATION_TYPE,
        CASE WHEN c_nationkey > 21 THEN 'XNA' ELSE concat('Type ', CAST(c_nationkey AS STRING)) END
             AS ORGANIZATION_TYPE,
        CAST(c_custkey % 4 AS INT) AS CNT_CHILDREN,
        CAST(-7000 - c_custkey * 37 % 18000 AS INT) AS DAYS_BIRTH,
        CAST(CASE WHEN c_custkey % 6 = 0 THEN 365243 ELSE -(c_custkey * 13 % 5000) END AS INT) AS DAYS_EMPLOYED,
        CAST(-(c_custkey * 11 % 4000) AS INT) AS DAYS_ID_PUBLISH,
        CAST(-(c_custkey * 5 % 1500) AS INT) AS DAYS_LAST_PHONE_CHANGE,
        CAST(-(c_custkey * 19 % 9000) AS INT) AS DAYS_REGISTRATION,
        CAST(c_nationkey % 2 AS INT) AS REG_CITY_NOT_WORK_CITY,
        CASE WHEN c_custkey % 29 = 0 THEN NULL ELSE 15000 + c_acctbal * 2 END AS AMT_ANNUITY,
        200000 + c_acctbal * 40 AS AMT_CREDIT,
        CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE 201000 + c_acctbal * 40 - c_custkey % 3 * 1000 END
             AS AMT_GOODS_PRICE,
        30000 + c_acctbal * 10 AS AMT_INCOME_TOTAL,
        CAST(c_custkey % 7 AS DOUBLE) AS AMT_REQ_CREDIT_BUREAU_YEAR,
        {_share(3, 4)} AS APARTMENTS_AVG, {_share(7, 5)} AS BASEMENTAREA_AVG,
        CASE WHEN c_custkey % 31 = 0 THEN NULL ELSE CAST(c_custkey % 4 + c_nationkey % 3 AS DOUBLE) END
             AS CNT_FAM_MEMBERS,
        {_share(11, 3)} AS ELEVATORS_AVG, {_share(31, 2)} AS EXT_SOURCE_1, {_share(41, 9)} AS EXT_SOURCE_2,
        {_share(43, 5)} AS EXT_SOURCE_3, {_share(13, 6)} AS NONLIVINGAREA_AVG,
        CASE WHEN c_custkey % 3 = 0 THEN CAST(c_nationkey AS DOUBLE) END AS OWN_CAR_AGE,
        {_share(17, 7)} AS TOTALAREA_MODE, {_share(23, 8)} AS YEARS_BUILD_AVG
    FROM {{customer}}
"""

# One credit type never occurs.
_TYPES_IN_USE = [t for t in CREDIT_TYPES if t != "Interbank credit"]

_BUREAU = f"""
    SELECT o_custkey AS SK_ID_CURR, o_orderkey AS SK_ID_BUREAU,
        CASE WHEN o_orderstatus = 'F' THEN 'Closed' WHEN o_orderstatus = 'O' THEN 'Active'
             WHEN o_orderkey % 2 = 0 THEN 'Sold' ELSE 'Bad debt' END AS CREDIT_ACTIVE,
        concat('currency ', CAST(1 + o_orderkey % 4 AS STRING)) AS CREDIT_CURRENCY,
        {_case(f"o_orderkey % {len(_TYPES_IN_USE)}", _TYPES_IN_USE)} AS CREDIT_TYPE,
        CAST(o_orderkey % 3 AS INT) AS CNT_CREDIT_PROLONG,
        CAST(CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey * 7 % 130 ELSE 0 END AS INT) AS CREDIT_DAY_OVERDUE,
        o_day AS DAYS_CREDIT,
        CAST(CASE WHEN o_orderkey % 19 = 0 THEN -42000 WHEN o_orderkey % 23 = 0 THEN NULL
             ELSE o_day + o_orderkey * 3 % 3000 END AS INT) AS DAYS_CREDIT_ENDDATE,
        CAST(CASE WHEN o_orderkey % 37 = 0 THEN -41000 ELSE o_day + o_orderkey % 100 END AS INT)
             AS DAYS_CREDIT_UPDATE,
        CAST(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_day + o_orderkey % 900 END AS INT)
             AS DAYS_ENDDATE_FACT,
        CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 9 = 0 THEN 0 ELSE o_totalprice / 50 END
             AS AMT_ANNUITY,
        CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_totalprice / 200 END AS AMT_CREDIT_MAX_OVERDUE,
        o_totalprice AS AMT_CREDIT_SUM,
        CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 = 1 THEN 0 ELSE o_totalprice / 4 END
             AS AMT_CREDIT_SUM_DEBT,
        CASE WHEN o_orderkey % 8 = 0 THEN -100 WHEN o_orderkey % 8 = 1 THEN 0 WHEN o_orderkey % 8 = 2 THEN NULL
             ELSE o_totalprice / 2 END AS AMT_CREDIT_SUM_LIMIT,
        CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice / 100 ELSE 0 END AS AMT_CREDIT_SUM_OVERDUE
    FROM {{orders}}
"""

_BUREAU_BALANCE = """
    SELECT l_orderkey AS SK_ID_BUREAU, CAST(-(l_linenumber * 3 + l_partkey % 5) AS INT) AS MONTHS_BALANCE,
        CASE WHEN l_returnflag = 'A' THEN 'C' WHEN l_returnflag = 'N' THEN 'X'
             ELSE CAST(l_suppkey % 5 AS STRING) END AS STATUS
    FROM {lineitem}
"""

_PRODUCTS = ["Cash X-Sell: low", "POS household with interest", "Cash Street: high", "Card Street",
             "POS mobile without interest", "Card X-Sell"]


def _category(column: str, expression: str) -> str:
    return _case(expression, list(CATEGORY_COUNTS[column]))


_PREVIOUS = f"""
    SELECT o_orderkey AS SK_ID_PREV, o_custkey AS SK_ID_CURR,
        {_category("CODE_REJECT_REASON", "o_orderkey % 9")} AS CODE_REJECT_REASON,
        {_case("o_orderkey % 4", ["XNA", "XAP", "Repairs", "Car"])} AS NAME_CASH_LOAN_PURPOSE,
        {_category("NAME_CLIENT_TYPE", "o_orderkey % 4")} AS NAME_CLIENT_TYPE,
        {_category("NAME_CONTRACT_STATUS", "o_orderkey % 3")} AS NAME_CONTRACT_STATUS,
        {_case("o_orderkey % 4", ["Cash loans", "Consumer loans", "Revolving loans", "XNA"])}
             AS NAME_CONTRACT_TYPE,
        o_orderpriority AS NAME_PAYMENT_TYPE, o_orderstatus AS NAME_PORTFOLIO,
        {_case("o_orderkey % 3", ["XNA", "walk-in", "x-sell"])} AS NAME_PRODUCT_TYPE,
        {_case("o_orderkey % 2", ["XNA", "middle"])} AS NAME_YIELD_GROUP,
        CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE {_case("o_orderkey % 6", _PRODUCTS)} END
             AS PRODUCT_COMBINATION,
        CAST(o_orderkey % 60 AS INT) AS CNT_PAYMENT, o_day AS DAYS_DECISION,
        CAST(CASE WHEN o_orderkey % 12 = 0 THEN NULL ELSE o_day + 300 END AS INT) AS DAYS_FIRST_DUE,
        CAST(CASE WHEN o_orderkey % 14 = 0 THEN NULL ELSE o_day + o_orderkey % 700 END AS INT) AS DAYS_LAST_DUE,
        CAST(o_day + o_orderkey % 500 * 2 AS INT) AS DAYS_LAST_DUE_1ST_VERSION,
        CAST(CASE WHEN o_orderkey % 15 = 0 THEN NULL ELSE o_day + 710 END AS INT) AS DAYS_TERMINATION,
        CAST(o_orderkey % 24 AS INT) AS HOUR_APPR_PROCESS_START,
        CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice / 20 END AS AMT_ANNUITY,
        o_totalprice AS AMT_APPLICATION,
        CASE WHEN o_orderkey % 16 = 0 THEN 0 ELSE o_totalprice + (o_orderkey % 3 - 1) * 500 END AS AMT_CREDIT,
        CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice / 10 END AS AMT_DOWN_PAYMENT,
        CASE WHEN o_orderkey % 21 = 0 THEN NULL ELSE o_totalprice END AS AMT_GOODS_PRICE,
        CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 40 AS DOUBLE) / 100 END AS RATE_DOWN_PAYMENT
    FROM {{orders}}
"""

_POS = """
    SELECT user_id AS SK_ID_CURR, CAST(-(event_id % 60) AS INT) AS MONTHS_BALANCE,
        CAST(CASE WHEN event_id % 7 = 0 THEN event_id % 40 ELSE 0 END AS INT) AS SK_DPD,
        CAST(CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_id % 3 END AS INT) AS SK_DPD_DEF
    FROM {events}
"""

_INSTALMENTS = """
    SELECT l_orderkey AS SK_ID_PREV, o_custkey AS SK_ID_CURR,
        CAST(l_suppkey % 4 AS INT) AS NUM_INSTALMENT_VERSION, l_linenumber AS NUM_INSTALMENT_NUMBER,
        o_day AS DAYS_INSTALMENT,
        CAST(CASE WHEN l_partkey % 50 = 0 THEN NULL WHEN l_partkey % 3 = 0 THEN o_day ELSE l_day END AS INT)
             AS DAYS_ENTRY_PAYMENT,
        l_extendedprice AS AMT_INSTALMENT,
        CASE WHEN l_partkey % 50 = 0 THEN NULL WHEN l_discount = 0 THEN 0 WHEN l_tax = 0 THEN l_extendedprice
             ELSE l_extendedprice * (1 + l_tax - l_discount) END AS AMT_PAYMENT
    FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
"""

_CARD = """
    SELECT user_id * 10 + event_id % 3 AS SK_ID_PREV, user_id AS SK_ID_CURR,
        CAST(event_id % 5 AS INT) AS CNT_DRAWINGS_ATM_CURRENT, CAST(event_id % 8 AS INT) AS CNT_DRAWINGS_CURRENT,
        CAST(CASE WHEN event_id % 6 = 0 THEN NULL ELSE event_id % 2 END AS INT) AS CNT_DRAWINGS_OTHER_CURRENT,
        CAST(CASE WHEN event_id % 3 = 2 THEN NULL ELSE event_id % 30 END AS INT) AS CNT_INSTALMENT_MATURE_CUM,
        CAST(-(event_id % 96) AS INT) AS MONTHS_BALANCE, CAST(event_id % 11 AS INT) AS SK_DPD,
        CAST(event_id % 4 AS INT) AS SK_DPD_DEF,
        value * 100 AS AMT_BALANCE, CAST(event_id % 4 * 5000 AS DOUBLE) AS AMT_CREDIT_LIMIT_ACTUAL,
        CASE WHEN event_id % 13 = 0 THEN -50 WHEN event_id % 5 = 0 THEN 0 ELSE value * 2 END
             AS AMT_DRAWINGS_ATM_CURRENT,
        CASE WHEN event_id % 17 = 0 THEN -70 ELSE value * 3 END AS AMT_DRAWINGS_CURRENT,
        CASE WHEN event_id % 6 = 0 THEN NULL ELSE value END AS AMT_DRAWINGS_OTHER_CURRENT,
        value / 2 AS AMT_DRAWINGS_POS_CURRENT,
        CASE WHEN event_id % 10 = 0 THEN NULL ELSE value * 4 END AS AMT_PAYMENT_CURRENT
    FROM {events}
"""

SQL = {
    "applicants": _APPLICANTS,
    "bureau": _BUREAU,
    "bureau_balance": _BUREAU_BALANCE,
    "previous_application": _PREVIOUS,
    "POS_CASH_Balance": _POS,
    "installments_payments": _INSTALMENTS,
    "credit_card_balance": _CARD,
}

_DUCK_SOURCES = {
    "customer": "customer",
    "events": "events",
    "orders": f"(SELECT *, CAST(datediff('day', TIMESTAMP '{APPLICATION_DATE}', o_orderdate) AS INT) AS o_day "
    "FROM orders)",
    "lineitem": f"(SELECT *, CAST(datediff('day', TIMESTAMP '{APPLICATION_DATE}', l_shipdate) AS INT) AS l_day "
    "FROM lineitem)",
}


def cte(*names: str) -> str:
    """The derived tables as a WITH list for the SQL side."""
    return ", ".join(f"{name} AS ({SQL[name].format(**_DUCK_SOURCES)})" for name in names)


def credit_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived table; the scan reads only the columns it needs."""
    day_zero = F.lit(APPLICATION_DATE).cast("date")
    days = {"orders": ("o_orderdate", "o_day"), "lineitem": ("l_shipdate", "l_day")}
    sources = {}
    for source in ("customer", "events", "orders", "lineitem"):
        if f"{{{source}}}" in SQL[name]:
            df = table(spark, sf_dir, source)
            if source in days:
                date, day = days[source]
                df = df.withColumn(day, F.datediff(date, day_zero))
            sources[source] = df
    return spark.sql(SQL[name], **sources)


def credit_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All eight source tables; applicants without a label form the test split."""
    tables = {name: credit_table(spark, sf_dir, name) for name in SQL if name != "applicants"}
    applicants = credit_table(spark, sf_dir, "applicants")
    is_test = F.col("SK_ID_CURR") % 5 == 0
    tables["application_train"] = applicants.where(~is_test)
    tables["application_test"] = applicants.where(is_test).drop("TARGET")
    return tables
