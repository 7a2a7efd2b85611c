import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.functions.aggregates import aggregate
from riskloom.operators.recipe import cross_specs, distinct_counts, recipe_agg

FNS = ("sum", "mean", "min", "max", "var", "std", "count", "size", "nunique", "skew", "median")


def frame(seed):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"k": rng.integers(0, 12, 120).astype(float), "v": rng.normal(0, 5, 120).round(3)})
    pdf.loc[rng.random(120) < 0.2, "v"] = np.nan
    pdf.loc[rng.random(120) < 0.1, "k"] = np.nan
    edge = [(100, 4.0), (101, 2.0), (101, 2.0), (101, 2.0), (102, None), (102, None), (103, 1.0), (103, 5.0)]
    return pd.concat([pdf, pd.DataFrame(edge, columns=["k", "v"])], ignore_index=True)


def to_spark(spark, pdf):
    cells = pdf.astype(object).where(pdf.notna(), None).values.tolist()
    return spark.createDataFrame([tuple(r) for r in cells], "k double, v double")


def check(got, wanted):
    assert set(got) == set(wanted)
    for key, value in wanted.items():
        mine = got[key]
        if value is None or (isinstance(value, float) and np.isnan(value)):
            assert mine is None, key
        else:
            assert mine == pytest.approx(value, rel=1e-9, abs=1e-9), key


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("fn", FNS)
def test_same_as_a_data_frame_library(spark, fn, seed):
    pdf = frame(seed)
    df = recipe_agg(to_spark(spark, pdf), ["k"], [("v", fn)], "x")
    got = {r.k: r.x for r in df.collect()}
    groups = pdf.groupby("k")
    wanted = groups.size() if fn == "size" else groups["v"].agg(fn)
    check(got, wanted.to_dict())


def population(fn, values):
    x = np.asarray(values, dtype=float)
    if np.isnan(x).any():
        return np.nan
    d = x - x.mean()
    m2 = (d**2).mean()
    if fn == "iqr":
        return np.percentile(x, 75) - np.percentile(x, 25)
    if m2 == 0:
        return np.nan
    return (d**3).mean() / m2**1.5 if fn == "skew_pop" else (d**4).mean() / m2**2 - 3


@pytest.mark.parametrize("fn", ("skew_pop", "kurt", "iqr"))
def test_population_moments_need_complete_groups(spark, fn):
    pdf = frame(5)
    df = recipe_agg(to_spark(spark, pdf), ["k"], [("v", fn)], "x")
    check({r.k: r.x for r in df.collect()}, {k: population(fn, g["v"]) for k, g in pdf.groupby("k")})


@pytest.mark.parametrize("fn", ("sum", "mean", "min", "max", "count", "nunique"))
def test_condition_equals_filtering_first_and_joining_back(spark, fn):
    pdf = frame(7)
    keys = pdf["k"].dropna().unique()
    wanted = pdf[pdf["v"] > 0].groupby("k")["v"].agg(fn).reindex(keys)
    df = to_spark(spark, pdf).where("k IS NOT NULL").groupBy("k").agg(aggregate(fn, "v", F.col("v") > 0).alias("x"))
    check({r.k: r.x for r in df.collect()}, wanted.to_dict())


def test_sum_of_a_present_subset_without_values_is_zero(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 3.0)], "k int, c string, v double")
    got = df.groupBy("k").agg(aggregate("sum", "v", F.col("c") == "a").alias("x"))
    assert {r.k: r.x for r in got.collect()} == {1: 0.0, 2: None}


def test_infinite_values(spark):
    inf = float("inf")
    df = spark.createDataFrame([(1, inf), (1, 2.0), (2, inf), (2, -inf)], "k int, v double")
    got = {r.k: r for r in recipe_agg(df, ["k"], cross_specs(["v"]), "{fn}").collect()}
    assert (got[1].mean, got[1].max, got[1]["sum"], got[1].var) == (inf, inf, inf, None)
    assert (got[2].mean, got[2].max, got[2]["sum"], got[2].var) == (None, inf, None, None)


def test_distinct_counts_under_conditions(spark):
    pdf = frame(11)
    pdf["v"] = pdf["v"].round(0)
    outputs = {"all": None, "high": F.col("v") > 2, "any_row": F.col("k") > 5}
    got = distinct_counts(to_spark(spark, pdf), ["k"], "v", outputs).collect()
    keys = pdf["k"].dropna().unique()
    for name, subset in {"all": pdf, "high": pdf[pdf["v"] > 2], "any_row": pdf[pdf["k"] > 5]}.items():
        wanted = subset.groupby("k")["v"].nunique().reindex(keys)
        check({r.k: r[name] for r in got}, wanted.to_dict())
