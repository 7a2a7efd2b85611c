"""What the physical plans look like, since that is what decides the cost at scale."""

import re

import pytest

from riskloom.operators.latest import last_k, last_k_agg, latest_one
from riskloom.operators.recipe import cross_specs, recipe_agg
from riskloom.plans import application, bureau, instalments, previous
from riskloom.queries.credit_tables import credit_table, credit_tables
from riskloom.operators.groupstats import GroupStats


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return len(re.findall(r"Exchange hashpartitioning", plan_of(df)))


@pytest.fixture(scope="module")
def events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def test_recipes_take_one_shuffle_and_read_only_their_columns(events):
    narrow = recipe_agg(events, ["user_id"], cross_specs(["value"]))
    wide = recipe_agg(events, ["user_id"], cross_specs(["value", "event_id"], ("mean", "min", "max", "sum", "var", "std", "count", "skew", "size", "nunique", "kurt", "skew_pop")[:9]) + cross_specs(["value"], ("kurt", "skew_pop")) + cross_specs(["event_id"], ("kurt", "skew_pop", "iqr", "median")))
    for df, columns in ((narrow, "user_id:bigint,value:double"), (wide, "event_id:bigint,user_id:bigint,value:double")):
        assert shuffles(df) == 1
        assert f"ReadSchema: struct<{columns}>" in plan_of(df)
        assert "PushedFilters: [IsNotNull(user_id)]" in plan_of(df)
    assert "partial_var_samp" in plan_of(narrow).split("Exchange")[1]
    # The wide recipe shuffles rows, not buffers: nothing is aggregated below its exchange.
    assert "Aggregate" not in plan_of(wide).split("Exchange")[1]


def test_last_k_takes_one_shuffle_and_prunes_before_it(events):
    specs = [("value", fn) for fn in ("sum", "mean", "median", "skew_pop")]
    assert shuffles(last_k_agg(events, ["user_id"], "ts", specs, (1, 5, 10), ["event_id"])) == 1
    below = plan_of(last_k(events, ["user_id"], "ts", 10, ["event_id"])).split("Exchange hashpartitioning")[1]
    assert "WindowGroupLimit" in below and "Partial" in below


def test_latest_row_is_combined_before_the_shuffle(events):
    df = latest_one(events, ["user_id"], "ts", {"value": "v"}, ["event_id"])
    assert shuffles(df) == 1 and "partial_max" in plan_of(df).split("Exchange")[1]


def test_small_group_statistics_never_shuffle_the_rows(spark, sf_dir):
    train = application.row_features(credit_tables(spark, sf_dir)["application_train"])
    stats = GroupStats.fit(train, application.GROUP_RECIPES)
    plan = plan_of(stats.transform(train))
    assert plan.count("BroadcastHashJoin") == 8 and "SortMergeJoin" not in plan


def test_no_python_and_no_cross_join_in_any_plan(spark, sf_dir):
    tables = credit_tables(spark, sf_dir)
    plans = [
        bureau.bureau_features(tables["bureau"]),
        bureau.bureau_balance_features(tables["bureau"], tables["bureau_balance"]),
        previous.previous_features(tables["previous_application"]),
        instalments.instalment_features(tables["previous_application"], tables["installments_payments"]),
    ]
    for df in plans:
        plan = plan_of(df)
        assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan
        assert "BroadcastNestedLoopJoin" not in plan


def test_loan_features_need_only_the_two_clusterings(spark, sf_dir):
    df = instalments.loan_features(spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(
        "l_orderkey AS SK_ID_PREV", "l_suppkey AS SK_ID_CURR", "l_linenumber AS NUM_INSTALMENT_NUMBER",
        "l_linenumber AS NUM_INSTALMENT_VERSION", "l_linenumber AS DAYS_INSTALMENT",
        "l_linenumber AS DAYS_ENTRY_PAYMENT", "l_tax AS AMT_PAYMENT", "l_discount AS AMT_INSTALMENT"))
    assert shuffles(df) == 2


def test_derived_tables_keep_every_row(spark, sf_dir):
    for name, source in (("bureau", "orders"), ("bureau_balance", "lineitem"), ("POS_CASH_Balance", "events")):
        assert credit_table(spark, sf_dir, name).count() == spark.read.parquet(f"{sf_dir}/{source}.parquet").count()
