import datetime

import pytest
from pyspark.sql import functions as F

from riskloom.functions.scalars import (
    band_flag, contains_flag, days_between, flag, known_category, null_below, null_if, null_if_in,
    ratio, row_reduce, tri_flag, weighted_sum,
)

INF = float("inf")


def one(spark, schema, row, column):
    return spark.createDataFrame([row], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "num, den, ieee, null",
    [
        (6.0, 3.0, 2.0, 2.0),
        (1.0, 0.0, INF, None),
        (-1.0, 0.0, -INF, None),
        (0.0, 0.0, None, None),
        (None, 0.0, None, None),
        (1.0, None, None, None),
        (INF, INF, None, None),
        (INF, 2.0, INF, INF),
    ],
)
def test_ratio(spark, num, den, ieee, null):
    assert one(spark, "a double, b double", (num, den), ratio("a", "b")) == ieee
    if num != INF:
        assert one(spark, "a double, b double", (num, den), ratio("a", "b", "null")) == null


def test_ratio_of_integers_divides_as_doubles(spark):
    assert one(spark, "a int, b int", (1, 4), ratio("a", "b")) == 0.25
    with pytest.raises(ValueError):
        ratio("a", "b", "zero")


@pytest.mark.parametrize("value, expected", [("XNA", None), ("M", "M"), (None, None)])
def test_sentinels(spark, value, expected):
    assert one(spark, "a string", (value,), null_if("a", "XNA")) == expected
    assert one(spark, "a string", (value,), null_if_in("a", ["XNA", "XAP"])) == expected


@pytest.mark.parametrize("value, expected", [(-40001, None), (-40000, -40000), (None, None)])
def test_null_below(spark, value, expected):
    assert one(spark, "a int", (value,), null_below("a", -40000)) == expected


@pytest.mark.parametrize("value, expected", [(1, 1), (5, 0), (None, 0)])
def test_flag_counts_unknown_as_zero(spark, value, expected):
    assert one(spark, "a int", (value,), flag(F.col("a") < 5)) == expected


@pytest.mark.parametrize("value, expected", [(30, 0), (31, 1), (60, 1), (61, 0), (None, 0)])
def test_band_is_open_below_and_closed_above(spark, value, expected):
    assert one(spark, "a int", (value,), band_flag("a", 30, 60)) == expected


@pytest.mark.parametrize("a, b, expected", [(1, 2, 1), (2, 2, 0), (3, 2, 0), (None, 2, None), (1, None, None)])
def test_tri_flag(spark, a, b, expected):
    assert one(spark, "a int, b int", (a, b), tri_flag("a", "b")) == expected


@pytest.mark.parametrize("text, expected, as_one", [("cash x-SELL", 1, 1), ("50% off_", 0, 0), (None, 0, 1)])
def test_contains_is_literal_and_ignores_case(spark, text, expected, as_one):
    assert one(spark, "a string", (text,), contains_flag("a", "X-Sell")) == expected
    assert one(spark, "a string", (text,), contains_flag("a", "X-Sell", null_as=1)) == as_one
    if text and "%" in text:
        assert one(spark, "a string", (text,), contains_flag("a", "0% o")) == 1
        assert one(spark, "a string", (text,), contains_flag("a", "f_o")) == 0


@pytest.mark.parametrize(
    "values, expected",
    [
        ((3.0, 1.0, 2.0), {"min": 1.0, "max": 3.0, "sum": 6.0, "mean": 2.0, "median": 2.0}),
        ((3.0, None, 2.0), {"min": 2.0, "max": 3.0, "sum": 5.0, "mean": 2.5, "median": 2.5}),
        ((None, None, 7.0), {"min": 7.0, "max": 7.0, "sum": 7.0, "mean": 7.0, "median": 7.0}),
        ((None, None, None), {"min": None, "max": None, "sum": 0.0, "mean": None, "median": None}),
    ],
)
def test_row_reduce(spark, values, expected):
    df = spark.createDataFrame([values], "a double, b double, c double")
    got = df.select(*[row_reduce(["a", "b", "c"], fn).alias(fn) for fn in expected]).first().asDict()
    assert got == expected


def test_weighted_sum_and_days(spark):
    assert one(spark, "a double, b double", (1.0, 2.0), weighted_sum({"a": 2, "b": 3})) == 8.0
    assert one(spark, "a double, b double", (1.0, None), weighted_sum({"a": 2, "b": 3})) is None
    dates = (datetime.date(2020, 1, 1), datetime.date(2020, 1, 31))
    assert one(spark, "a date, b date", dates, days_between("a", "b")) == 30


def test_unknown_category_fails_the_job(spark):
    assert one(spark, "a string", (None,), known_category("a", ["x"])) is None
    assert one(spark, "a string", ("x",), known_category("a", ["x"])) == "x"
    with pytest.raises(Exception, match="unknown category: y"):
        one(spark, "a string", ("y",), known_category("a", ["x"]))
