"""The build as a whole: what is shared between the feature tables."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import skew
from riskloom.operators.joins import attach, attach_packed
from riskloom.plans import assemble
from riskloom.queries.credit_tables import credit_tables
from riskloom.session import shared_dir
from riskloom.sources.manifest import Manifest, fingerprint_of_files
from riskloom.sources.tables import stage_buckets, write_csv


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_tables_attach_without_a_shuffle(spark, no_broadcast):
    spine = stage_buckets(spark.range(1000).selectExpr("id AS k", "id % 7 AS x"), "spine", ["k"])
    children = [
        stage_buckets(spark.range(0, 1000, step).selectExpr("id AS k", f"id * {step} AS v{step}"), "child", ["k"]) for step in (2, 3, 5)
    ]
    wide = attach(spine, *children, on=["k"])
    assert plan_of(wide).count("SortMergeJoin") == 3 and "Exchange" not in plan_of(wide)
    assert wide.count() == 1000
    assert [tuple(r) for r in wide.where("k = 30").collect()] == [(30, 2, 60, 90, 150)]


def test_children_share_searches_and_clusterings(spark, sf_dir, monkeypatch, no_broadcast):
    searched = []
    search = skew.hot_keys
    monkeypatch.setattr(skew, "hot_keys", lambda df, keys, *a: searched.append(tuple(keys)) or search(df, keys, *a))
    tables = credit_tables(spark, sf_dir)
    children = {name: make() for name, make in assemble.child_features(tables, stored=True).items()}
    assert searched == [("SK_ID_CURR",)] * 4  # credits, applications, payments, card balances
    for name in ("payments", "last_k"):
        assert "Exchange" not in plan_of(children[name]), name
    # The payments of a loan lie with their applicant: below each shuffle of their features there is none.
    lines = plan_of(children["loans"]).split("\n")
    scans = [i for i, line in enumerate(lines) if "riskloom_" in line]
    assert len(scans) == 2
    for i in scans:
        above = [line for line in lines[:i] if "Exchange" in line or "HashAggregate" in line]
        assert [("Exchange" in line) for line in above[-5:]] == [True, False, False, False, False]


@pytest.mark.parametrize("hot_rows", [3, 10**6])
def test_stored_payments_give_the_same_features(spark, sf_dir, hot_rows):
    tables = credit_tables(spark, sf_dir)
    payments = tables["installments_payments"]
    stored = assemble.payments_of(payments, hot_rows, "payments")
    assert (stored.frequent is None) == (hot_rows > 3)
    for features in (assemble.payment_features, assemble.last_k_features):
        ours, plain = (features(p).toPandas().sort_values("SK_ID_CURR").astype(float) for p in (stored, payments))
        # Sums in another order; moments of equal values may differ from zero by a little.
        np.testing.assert_allclose(ours.to_numpy(), plain[ours.columns].to_numpy(), rtol=1e-8, atol=1e-6)


def test_the_wide_table_joins_without_a_shuffle(spark, sf_dir, no_broadcast):
    wide = assemble.wide_table(credit_tables(spark, sf_dir), stage_children=True)
    plan = plan_of(wide)
    assert plan.count("SortMergeJoin") == 8 and "Exchange" not in plan


def test_a_build_goes_on_and_leaves_nothing(spark, sf_dir, tmp_path, monkeypatch):
    folder, out = tmp_path / "in", tmp_path / "out"
    for name, df in credit_tables(spark, sf_dir).items():
        write_csv(df, str(folder / f"{name}.csv"))
    shared = Path(shared_dir(spark).removeprefix("file:"))
    files = lambda: {p for part in ("riskloom-build", "riskloom-stage") for p in (shared / part).rglob("*.parquet") if p.is_file()}
    before = files()
    manifests = []
    monkeypatch.setattr(assemble, "Manifest", lambda *a: manifests.append(Manifest(*a)) or manifests[-1])

    def dies(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(assemble, "card_features", dies)
        with pytest.raises(RuntimeError, match="lost"):
            assemble.build(spark, str(folder), str(out))
    assert len(manifests[0].made) == 16 and not manifests[0].found  # the sources and seven children; the eighth died
    wide = assemble.build(spark, str(folder), str(out))
    assert set(manifests[1].found) == set(manifests[0].made) - {"credit_card_balance_features"}
    assert set(manifests[1].made) == {"credit_card_balance_features", "applicants_features"}
    assert files() == before
    plain = assemble.wide_table(assemble.load_sources(spark, str(folder)))
    assert wide.count() == plain.count() and set(wide.columns) == set(plain.columns)
    sums = [F.sum(F.col(c).cast("double")) for c in ("bur_num_credits", "preapps_num_credits", "credit_card_number_of_loans")]
    assert wide.agg(*sums).first() == plain.agg(*sums).first()


def test_fingerprints_follow_the_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x")
    first = fingerprint_of_files(spark, str(tmp_path))
    assert fingerprint_of_files(spark, str(tmp_path)) == first
    (tmp_path / "a.csv").write_text("xy")
    second = fingerprint_of_files(spark, str(tmp_path))
    (tmp_path / "b.csv").write_text("z")
    assert len({first, second, fingerprint_of_files(spark, str(tmp_path))}) == 3


def test_packed_tables_attach_like_flat_ones_and_join_arrays(spark):
    spine = spark.createDataFrame([(1, 5, "a", 0.5), (1, 6, None, None), (None, 7, "b", 1.5), (3, None, "c", 2.5)], "k long, i int, s string, `d.x` double")
    children = [
        spark.createDataFrame([(1, 2**60 + 1, 1.25, True), (3, None, None, None), (None, 9, 9.0, False)], "k long, l long, v double, b boolean"),
        spark.createDataFrame([(1, "p"), (1, "q")], "k long, t string"),
    ]
    ours, flat = attach_packed(spine, *children, on=["k"]), attach(spine, *children, on=["k"])
    assert [(f.name, f.dataType) for f in ours.schema] == [(f.name, f.dataType) for f in flat.schema]
    assert sorted(map(str, ours.collect())) == sorted(map(str, flat.collect()))
    with pytest.raises(ValueError, match="duplicate"):
        attach_packed(spine, children[0], children[0], on=["k"])
    more = attach_packed(spine, *children, on=["k"], inputs=["i", "l"], derive=lambda df: df.selectExpr("*", "i + l AS total"))
    assert more.columns == [*flat.columns, "total"]
    assert {r["total"] for r in more.where("k = 1").collect()} == {2**60 + 6, 2**60 + 7}


def test_the_wide_table_goes_through_the_joins_in_arrays(spark, sf_dir, no_broadcast):
    wide = assemble.wide_table(credit_tables(spark, sf_dir), stage_children=True)
    plan = wide._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Join":
        plan = plan.children().head()
    assert len(wide.columns) > 1000 and plan.output().size() < 60


def test_plans_of_the_build_are_compiled_in_any_session(spark, sf_dir, monkeypatch):
    name, seen = "spark.sql.codegen.hugeMethodLimit", []
    before = spark.conf.get(name)
    spark.conf.set(name, "65535")
    try:
        monkeypatch.setattr(assemble, "card_features", lambda df, make=assemble.card_features: seen.append(spark.conf.get(name)) or make(df))
        assemble.wide_table(credit_tables(spark, sf_dir), stage_children=True)
        assert seen == ["8000"] and spark.conf.get(name) == "65535"
    finally:
        spark.conf.set(name, before)
