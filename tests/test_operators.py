import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators.bloom import likely_members
from riskloom.operators.groupstats import GroupStats, Recipe
from riskloom.operators.joins import attach, key_spine, prefixed
from riskloom.operators.latest import last_k, last_k_agg, last_k_apply, latest_one, latest_rows, with_group_stat
from riskloom.operators.pivot import first_occurrence_columns, pivot_columns
from riskloom.operators.profile import numeric_columns, string_columns, table_shape, value_counts
from riskloom.operators.quantiles import group_quantiles, quantiles_across_tasks
from riskloom.operators.recipe import cross_specs, recipe_agg
from riskloom.operators.skew import by_key, hot_keys

from comparable import rows


@pytest.fixture(scope="module")
def skewed(spark):
    """One key with a third of the rows, a missing key with another third, identical copies."""
    n = 900
    data = [(1 if i % 3 == 0 else None if i % 3 == 1 else 10 + i % 40, i % 7, float(i % 50)) for i in range(n)]
    data += [(1, 0, 0.0)] * 100
    return spark.createDataFrame(data, "k int, t int, v double").repartition(6).cache()


@pytest.mark.parametrize("hot_rows", [1, 50, 10**6])
def test_join_back_is_the_same_hot_or_cold(skewed, hot_rows):
    got = with_group_stat(skewed, ["k"], "v", "max", "top", hot_rows)
    tops = {r.k: r.top for r in skewed.where("k IS NOT NULL").groupBy("k").agg(F.max("v").alias("top")).collect()}
    wanted = [(str(r.k), str(r.t), tops.get(r.k), r.v) for r in skewed.collect()]
    assert rows(got) == sorted((k, t, "None" if top is None else f"{top:.12g}" if top else "0", f"{v:.12g}" if v else "0") for k, t, top, v in wanted)


def test_join_back_spreads_served_rows(spark):
    copies = spark.range(0, 64_000, 1, 16).select(F.lit(1).alias("k") + F.col("id") * 0, F.lit(2.0).alias("v"))
    df = copies.toDF("k", "v").unionByName(spark.createDataFrame([(2, 1.0)], "k long, v double"))
    # Neither broadcasting the small side nor coalescing may hide where the rows go.
    for key, value in (("autoBroadcastJoinThreshold", "-1"), ("adaptive.enabled", "false")):
        spark.conf.set(f"spark.sql.{key}", value)
    try:
        got = with_group_stat(df, ["k"], "v", "max", "top", hot_rows=1000)
        assert "hashpartitioning(k" in (plan := got._jdf.queryExecution().executedPlan().toString())
        assert "_slot" in plan.split("hashpartitioning(k")[1].split("\n")[0]
        sizes = [r.n for r in got.groupBy(F.spark_partition_id()).agg(F.count("top").alias("n")).collect()]
        # Identical copies too: those of one map task travel together, not those of the key.
        assert sum(sizes) == 64_001 and max(sizes) < 64_000 / 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_hot_keys_are_found_on_a_sample_too(spark):
    df = spark.range(400_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    assert [r.k for r in hot_keys(df, ["k"], 100_000).collect()] == [0]


@pytest.mark.parametrize("hot_rows", [1, 50, 10**6])
def test_wide_recipe_is_the_same_hot_or_cold(skewed, hot_rows):
    wide = skewed.withColumns({f"v{i}": F.col("v") + i for i in range(6)})
    specs = cross_specs([f"v{i}" for i in range(6)], ("min", "max", "sum", "mean"))
    plain = wide.where("k IS NOT NULL").groupBy("k").agg(
        *[getattr(F, "avg" if fn == "mean" else fn)(c).alias(f"k_{fn}_{c}") for c, fn in specs]
    )
    assert rows(recipe_agg(wide, ["k"], specs, hot_rows=hot_rows)) == rows(plain)


def test_by_key_drops_missing_keys_and_keeps_every_other(skewed):
    got = by_key(skewed, ["k"], lambda r: r.groupBy("k").agg(F.count("v").alias("n")), hot_rows=100)
    assert rows(got) == rows(skewed.where("k IS NOT NULL").groupBy("k").agg(F.count("v").alias("n")))


@pytest.mark.parametrize("hot_rows", [1, 60, 10**6])
def test_quantiles_are_exact(spark, hot_rows):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": rng.choice([1, 1, 1, 2, 3], 700), "a": rng.normal(0, 9, 700), "b": rng.integers(0, 4, 700).astype(float)})
    edge = pd.DataFrame([(4, 1.5, None), (5, 1.0, 2.0), (5, 4.0, 2.0)], columns=["k", "a", "b"])
    pdf = pd.concat([pdf, edge], ignore_index=True)
    df = spark.createDataFrame([(int(k), a, None if np.isnan(b) else b) for k, a, b in pdf.values.tolist()], "k int, a double, b double")
    probs = (0.0, 0.1, 0.5, 0.75, 1.0)
    got = {r.k: r for r in group_quantiles(df, ["k"], ["a", "b"], probs, hot_rows).collect()}
    for k, group in pdf.groupby("k"):
        for c in ("a", "b"):
            values = group[c].dropna()
            if values.empty:
                assert got[k][c] is None
            else:
                assert got[k][c] == pytest.approx(list(np.quantile(values, probs)), rel=1e-12)
    assert len(got) == 5


def test_quantiles_across_tasks_keep_all_null_keys(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 3.0)], "k int, a double")
    assert {r.k: r.a for r in quantiles_across_tasks(df, ["k"], ["a"], [0.5]).collect()} == {1: None, 2: [3.0]}


def test_latest(spark):
    df = spark.createDataFrame(
        [(1, 5, 1, "a"), (1, 7, 2, "b"), (1, 7, 3, "c"), (2, None, 4, "d"), (3, 1, 5, None), (None, 9, 6, "z")],
        "k int, t int, id int, v string",
    )
    assert rows(latest_rows(df, ["k"], "t").select("k", "id")) == [("2", "1"), ("3", "1"), ("5", "3")]
    one = latest_one(df, ["k"], "t", {"v": "newest"}, ["id"])
    assert {r.k: r.newest for r in one.collect()} == {1: "c", 3: None}


def test_last_k_orders_missing_last(spark):
    df = spark.createDataFrame([(1, 3, 0), (1, None, 1), (1, 9, 2), (1, 9, 3)], "k int, t int, id int")
    ranked = {r.id: r._rank for r in last_k(df, ["k"], "t", 3, ["id"]).collect()}
    assert ranked == {3: 1, 2: 2, 0: 3}


def population_skew(x):
    d = x - x.mean()
    return np.nan if x.isna().any() or (d**2).mean() == 0 else (d**3).mean() / (d**2).mean() ** 1.5


@pytest.mark.parametrize("hot_rows", [5, 10**6])
def test_last_k_aggregates_against_brute_force(spark, hot_rows):
    rng = np.random.default_rng(1)
    data = [(k, t, float(rng.integers(0, 9)) if rng.random() > 0.05 else None)
            for k, n in ((1, 1), (2, 4), (3, 6), (4, 21), (5, 101)) for t in range(n)]
    pdf = pd.DataFrame(data, columns=["k", "t", "v"]).astype({"v": float})
    df = spark.createDataFrame(data, "k int, t int, v double").repartition(5)
    ks = (1, 5, 10, 20, 50, 100)
    specs = [("v", fn) for fn in ("sum", "mean", "max", "min", "std", "count", "median", "skew")]
    got = {r.k: r for r in last_k_agg(df, ["k"], "t", specs, ks, fns={"skew": "skew_pop"}, hot_rows=hot_rows).collect()}
    for key, group in pdf.groupby("k"):
        group = group.sort_values("t", ascending=False)
        for k in ks:
            head = group["v"].iloc[:k]
            for _, fn in specs:
                wanted = population_skew(head) if fn == "skew" else getattr(head, fn)()
                mine = got[key][f"last_{k}_v_{fn}"]
                assert (mine is None) if np.isnan(wanted) else mine == pytest.approx(wanted, abs=1e-9), (key, k, fn)


def test_last_k_apply_hands_over_at_most_k_rows(spark):
    df = spark.createDataFrame([(1, t, float(t)) for t in range(9)] + [(2, 0, 1.0)], "k int, t int, v double")
    got = last_k_apply(df, ["k"], "t", 4, lambda g: pd.DataFrame({"k": g.k.iloc[:1], "n": [len(g)], "first": g.v.iloc[:1].values}),
                       "k int, n long, first double")
    assert {r.k: (r.n, r.first) for r in got.collect()} == {1: (4, 8.0), 2: (1, 1.0)}


RECIPES = (
    Recipe(("a", "b"), (("v", "mean"), ("v", "max"), ("v", "min"))),
    Recipe(("a",), (("v", "sum"), ("v", "count"), ("w", "mean"))),
)


@pytest.mark.parametrize("limit", [0, 1000])
def test_group_statistics_come_from_train_only(spark, limit):
    schema = "id int, a string, b int, v double, w double"
    train = [(1, "x", 1, 2.0, None), (2, "x", 1, 4.0, None), (3, "x", 2, None, None), (4, None, 1, 9.0, 1.0), (5, "y", None, 5.0, 3.0)]
    test = [(6, "x", 1, 10.0, 1.0), (7, "new", 1, 1.0, 1.0), (8, None, 1, 1.0, 1.0), (9, "y", None, 1.0, None)]
    stats = GroupStats.fit(spark.createDataFrame(train, schema), RECIPES, broadcast_rows=limit)
    got = {r.id: r for r in stats.transform(spark.createDataFrame(test, schema)).collect()}
    assert len(got) == 4
    assert (got[6].a_b_mean_v, got[6].a_b_max_v, got[6].a_b_mean_v_diff, got[6].a_b_mean_v_abs_diff) == (3.0, 4.0, 7.0, 7.0)
    assert (got[6].a_sum_v, got[6].a_count_v, got[6].a_mean_w) == (6.0, 2, None)
    assert not hasattr(got[6], "a_sum_v_diff")
    for id_ in (7, 8):
        assert got[id_].a_b_mean_v is None and got[id_].a_sum_v is None and got[id_].a_b_max_v_diff is None
    assert got[9].a_b_mean_v is None and got[9].a_sum_v == 5.0
    own = {r.id: r for r in stats.transform(spark.createDataFrame(train, schema)).collect()}
    assert own[3].a_b_mean_v is None and own[3].a_sum_v == 6.0


def test_group_statistics_reject_functions_that_do_not_roll_up(spark):
    with pytest.raises(ValueError, match="nunique"):
        GroupStats.fit(spark.createDataFrame([("x", 1.0)], "a string, v double"), [Recipe(("a",), (("v", "nunique"),))])


@pytest.mark.parametrize("limit", [0, 1000])
def test_medians_are_rolled_up_from_counts_of_values(spark, limit):
    rng = np.random.default_rng(9)
    n = 3000
    pdf = pd.DataFrame({"a": rng.choice(list("xyz") + [None], n), "b": rng.integers(0, 5, n), "v": rng.integers(0, 9, n) / 2, "w": rng.normal(size=n)})
    pdf.loc[rng.random(n) < 0.2, "v"] = np.nan
    pdf.loc[(pdf.a == "z") & (pdf.b == 4), "v"] = np.nan  # a group without values
    data = [(r.a, int(r.b), None if np.isnan(r.v) else r.v, r.w) for r in pdf.itertuples()]
    df = spark.createDataFrame(data, "a string, b int, v double, w double")
    recipes = [Recipe(("a", "b"), (("v", "median"), ("v", "mean"))), Recipe(("a",), (("v", "median"), ("w", "median"))), Recipe(("b",), (("w", "median"),))]
    got = GroupStats.fit(df, recipes, broadcast_rows=limit).transform(df).toPandas()
    assert len(got) == n
    for r in recipes:
        for c in r.medians:
            name = r.output(c, "median")
            wanted = pdf.groupby(list(r.keys))[c].median().rename("wanted").reset_index()
            both = got.merge(wanted, on=list(r.keys), how="left")
            np.testing.assert_allclose(both[name].astype(float), both["wanted"].astype(float), rtol=1e-12)
            np.testing.assert_allclose(both[f"{name}_diff"].astype(float), (both[c] - both["wanted"]).astype(float), atol=1e-12)


def test_pivot_emits_every_category(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "b", 2.0), (2, "b", 3.0)], "k int, c string, v double")
    names = {"a": "n_a", "b": "n_b", "z": "n_z"}
    got = {r.k: (r.n_a, r.n_b, r.n_z) for r in recipe_agg(df, ["k"], extra=pivot_columns("c", names, "count", "v")).collect()}
    assert got == {1: (0, 1, None), 2: (None, 1, None)}
    sums = {r.k: (r.n_a, r.n_b) for r in recipe_agg(df, ["k"], extra=pivot_columns("c", names, "sum", "v")).collect()}
    assert sums == {1: (0.0, 2.0), 2: (None, 3.0)}


def test_first_occurrence_counts_from_the_first_month(spark):
    df = spark.createDataFrame([(1, "0", -5), (1, "C", -3), (1, "C", -1), (2, "C", -9)], "k int, s string, m int")
    got = recipe_agg(df, ["k"], extra=first_occurrence_columns("s", {"0": "f0", "C": "fC", "X": "fX"}, "m"))
    assert {r.k: (r.f0, r.fC, r.fX) for r in got.collect()} == {1: (1, 3, None), 2: (None, 1, None)}


def test_spine_and_attach(spark):
    left = spark.createDataFrame([(1,), (2,), (2,)], "k int")
    right = spark.createDataFrame([(3,)], "k int")
    spine = key_spine(["k"], left, right)
    features = spark.createDataFrame([(2, 5)], "k int, x int")
    assert rows(attach(spine, features, on=["k"])) == [("1", "None"), ("2", "5"), ("3", "None")]
    with pytest.raises(ValueError, match="x"):
        attach(spine, features, features, on=["k"])
    assert attach(spine, features, prefixed(features, "p__", ["k"]), on=["k"]).columns == ["k", "x", "p__x"]


def test_profile(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4)], "c string, n int")
    assert [tuple(r) for r in value_counts(df, "c").collect()] == [("b", 2), ("a", 1)]
    assert tuple(table_shape(df).first()) == (4, 2)
    assert numeric_columns(df) == ["n"] and string_columns(df) == ["c"] and numeric_columns(df, ["n"]) == []


@pytest.mark.parametrize("hot_rows", [1, 50, 10**6])
def test_recipe_medians_are_the_same_hot_or_cold(skewed, hot_rows):
    specs = [("v", "median"), ("v", "sum"), ("v", "iqr")]
    got = recipe_agg(skewed, ["k"], specs, where=F.col("t") > 1, hot_rows=hot_rows)
    assert got.columns == ["k", "k_median_v", "k_sum_v", "k_iqr_v"]
    kept = skewed.toPandas().query("t > 1").groupby("k")["v"]
    for r in got.collect():
        if r.k in kept.groups:
            v = kept.get_group(r.k)
            assert (r.k_median_v, r.k_sum_v) == (v.median(), v.sum())
            assert r.k_iqr_v == pytest.approx(v.quantile(0.75) - v.quantile(0.25))


def test_a_long_list_of_hot_keys_is_not_broadcast(spark, skewed, monkeypatch):
    monkeypatch.setattr("riskloom.operators.skew.BROADCAST_KEYS", 3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:

        def count(route):
            return lambda df: df.groupBy("k").agg(F.count("*").alias("n"), F.lit(route).alias("route"))

        df = skewed.unionByName(spark.createDataFrame([(k, 0, 1.0) for k in range(500, 600)], skewed.schema))
        got = by_key(df, ["k"], count("usual"), 5, build_hot=count("hot"))
        assert "BroadcastExchange" not in got._jdf.queryExecution().executedPlan().toString()
        wanted = df.where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"))
        wanted = wanted.withColumn("route", F.when(F.col("n") > 5, "hot").otherwise("usual"))
        assert wanted.select("route").distinct().count() == 2 and rows(got) == rows(wanted)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_two_hundred_thousand_hot_keys_join_back_without_a_broadcast(spark):
    df = spark.range(0, 800_000, 1, 8).select((F.col("id") % 200_000).alias("k"), F.col("id").alias("v"))
    df = df.unionByName(spark.range(1000).select(F.lit(None).cast("long").alias("k"), F.col("id").alias("v")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = with_group_stat(df, ["k"], "v", "max", "top", hot_rows=2)
        assert "BroadcastExchange" not in got._jdf.queryExecution().executedPlan().toString()
        assert got.count() == 801_000
        assert got.where("k IS NOT NULL AND top <> k + 600000 OR k IS NULL AND top IS NOT NULL").isEmpty()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_latest_rows_shuffles_about_its_result(spark):
    df = spark.range(0, 400_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 5000).alias("k"), F.floor(F.col("id") / 1000).alias("t"), "id")
    newest = df.groupBy("k").agg(F.max("t").alias("t"))
    likely = likely_members(df, newest, ["k", "t"])
    result = latest_rows(df, ["k"], "t", hot_rows=100)
    wanted = df.join(newest, ["k", "t"], "left_semi").select(df.columns)
    assert rows(result) == rows(wanted)
    n = wanted.count()
    assert n <= likely.count() < n + 400_000 / 10
    odd = spark.createDataFrame([(1, None, 1), (1, 2.0, 2), (None, 9.0, 3), (2, None, 4), (1, 2.0, 2), (3, -0.0, 5), (3, 0.0, 6)], "k int, t double, id int")
    assert sorted(r.id for r in latest_rows(odd, ["k"], "t").collect()) == [2, 2, 5, 6]


def test_last_k_is_the_same_above_the_limit_of_the_optimizer(spark):
    data = [(1 if i % 3 else 2, i * 37 % 1009, i) for i in range(5000)]
    df = spark.createDataFrame(data, "k int, t int, id int").repartition(4)
    got = last_k(df, ["k"], "t", 1500, ["id"])
    best = {k: sorted(((t, i) for key, t, i in data if key == k), reverse=True)[:1500] for k in (1, 2)}
    assert {(r.k, r._rank): (r.t, r.id) for r in got.collect()} == {
        (k, n + 1): x for k, found in best.items() for n, x in enumerate(found)
    }
