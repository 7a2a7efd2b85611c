"""The feature plans on hand-made tables, through CSV files, with the awkward rows spelled out."""

import csv

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.plans import bureau, card, instalments, previous
from riskloom.plans.application import GROUP_RECIPES, row_features
from riskloom.plans.assemble import build, load_sources, split_of, wide_table
from riskloom.queries.credit_tables import credit_table
from riskloom.sources.schemas import SOURCES
from riskloom.sources.tables import read_csv



def table(spark, name, *records):
    """Rows of a source table from partial dictionaries; columns not named are missing."""
    schema = SOURCES[name]
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in records], schema)


def test_applicant_row_features(spark):
    df = table(
        spark,
        "application_test",
        dict(SK_ID_CURR=1, CODE_GENDER="XNA", ORGANIZATION_TYPE="XNA", DAYS_EMPLOYED=365243, DAYS_LAST_PHONE_CHANGE=0,
             CNT_CHILDREN=2, CNT_FAM_MEMBERS=2.0, AMT_INCOME_TOTAL=90.0, AMT_CREDIT=30.0, AMT_GOODS_PRICE=30.0,
             DAYS_BIRTH=-22646, EXT_SOURCE_1=0.1, EXT_SOURCE_3=0.3),
        dict(SK_ID_CURR=2, CODE_GENDER="F", DAYS_EMPLOYED=-1461, DAYS_LAST_PHONE_CHANGE=-5, DAYS_BIRTH=-22645,
             AMT_CREDIT=30.0, AMT_GOODS_PRICE=20.0, EXT_SOURCE_1=0.1, EXT_SOURCE_2=0.2, EXT_SOURCE_3=0.3),
    )
    one, two = row_features(df).orderBy("SK_ID_CURR").collect()
    assert (one.CODE_GENDER, one.ORGANIZATION_TYPE, one.DAYS_EMPLOYED, one.DAYS_LAST_PHONE_CHANGE) == (None,) * 4
    assert one.income_per_non_child == float("inf") and one.income_per_child == 30.0
    assert (one.retirement_age, one.longterm_employment, one.is_insured) == (1, 0, 0)
    assert (two.retirement_age, two.longterm_employment, two.is_insured) == (0, 1, 1)
    assert one.external_sources_weighted is None and one.external_sources_sum == pytest.approx(0.4)
    assert one.external_sources_nanmedian == pytest.approx(0.2)
    assert two.external_sources_weighted == pytest.approx(2.0)
    assert two.external_sources_nanmedian == pytest.approx(0.25) and two.external_sources_max == pytest.approx(2.0)


def test_group_recipes_have_48_outputs():
    outputs = [o for r in GROUP_RECIPES for o in r.outputs]
    assert len(outputs) == len({o[2] for o in outputs}) == 48


def test_bureau(spark):
    df = table(
        spark,
        "bureau",
        dict(SK_ID_CURR=1, SK_ID_BUREAU=10, CREDIT_ACTIVE="Active", CREDIT_TYPE="Mortgage", CREDIT_CURRENCY="currency 1",
             DAYS_CREDIT=-100, DAYS_CREDIT_ENDDATE=-10, AMT_ANNUITY=5.0, CREDIT_DAY_OVERDUE=91, AMT_CREDIT_SUM_LIMIT=-3.0),
        dict(SK_ID_CURR=1, SK_ID_BUREAU=11, CREDIT_ACTIVE="Closed", CREDIT_TYPE="Mortgage", CREDIT_CURRENCY="currency 2",
             DAYS_CREDIT=-50, DAYS_CREDIT_ENDDATE=-40001, CREDIT_DAY_OVERDUE=90),
        dict(SK_ID_CURR=2, SK_ID_BUREAU=12, CREDIT_ACTIVE="Active", CREDIT_DAY_OVERDUE=0, DAYS_CREDIT=0, CNT_CREDIT_PROLONG=1),
    )
    one, two = bureau.bureau_features(df).orderBy("SK_ID_CURR").collect()
    assert (one.bur_num_credits, one.bur_num_credit_types, one.bur_num_currency_types) == (2, 1, 2)
    assert (one.bur_num_credits_active, one.bur_num_credits_sold, one.bur_num_credits_typeMortgage) == (1, None, 2)
    assert (one.bur_num_past_active, one.bur_num_past_closed, one.num_DPD_90, two.num_DPD_90) == (1, None, 1, None)
    assert (one.bur_sum_annuity_active, one.bur_sum_annuity_closed, two.bur_sum_annuity_active) == (5.0, 0.0, 0.0)
    assert (one.bur_sum_creditlimit, one.bureau__SK_ID_CURR_mean_span_credit) == (0.0, 90.0)
    assert (one.bureau__SK_ID_CURR_sum_DPD_past_90, one.bureau__SK_ID_CURR_sum_DPD_btwn_60_90) == (1, 1)
    assert (two.bur_num_credit_types, two.bureau__SK_ID_CURR_count_CREDIT_TYPE, two.bureau__SK_ID_CURR_size_CREDIT_ACTIVE) == (0, 0, 1)
    assert two.bureau__SK_ID_CURR_max_cnt_prolonged_days_started_ratio == float("inf")
    bad = table(spark, "bureau", dict(SK_ID_CURR=1, SK_ID_BUREAU=1, CREDIT_ACTIVE="Frozen"))
    with pytest.raises(Exception, match="unknown category: Frozen"):
        bureau.bureau_features(bad).collect()


def test_bureau_balance(spark):
    credits = table(spark, "bureau", *[dict(SK_ID_CURR=c, SK_ID_BUREAU=b) for c, b in ((1, 10), (1, 11), (2, 12))])
    months = [(10, -5, "0"), (10, -4, "0"), (10, -2, "C"), (11, -9, "C")]
    balance = table(spark, "bureau_balance", *[dict(SK_ID_BUREAU=b, MONTHS_BALANCE=m, STATUS=s) for b, m, s in months])
    one, two = bureau.bureau_balance_features(credits, balance).orderBy("SK_ID_CURR").collect()
    assert (one.SK_ID_CURR_max_bubal_first_inst_with_SC, one.SK_ID_CURR_min_bubal_first_inst_with_SC) == (4, 1)
    assert one["SK_ID_CURR_sum_bubal_num_months_S-0"] == 2 and one["SK_ID_CURR_sum_bubal_num_months_S-5"] == 0
    assert one.SK_ID_CURR_mean_bubal_num_different_statuses == 1.5
    assert two.SK_ID_CURR_mean_bubal_num_different_statuses is None and two.SK_ID_CURR_sum_bubal_num_different_statuses == 0


def test_previous(spark):
    df = table(
        spark,
        "previous_application",
        dict(SK_ID_PREV=1, SK_ID_CURR=1, DAYS_DECISION=-5, NAME_CONTRACT_STATUS="Refused", PRODUCT_COMBINATION="Cash X-Sell: low",
             NAME_CONTRACT_TYPE="XNA", NAME_CLIENT_TYPE="XNA", DAYS_LAST_DUE=3),
        dict(SK_ID_PREV=2, SK_ID_CURR=1, DAYS_DECISION=-5, NAME_CONTRACT_STATUS="Approved", AMT_CREDIT=9.0, AMT_GOODS_PRICE=8.0),
        dict(SK_ID_PREV=3, SK_ID_CURR=1, DAYS_DECISION=-9, NAME_CONTRACT_STATUS="Canceled", DAYS_FIRST_DUE=-60),
        dict(SK_ID_PREV=4, SK_ID_CURR=2, NAME_CONTRACT_STATUS="Approved"),
    )
    one, two = previous.previous_features(df).orderBy("SK_ID_CURR").collect()
    assert (one.preapps_num_credits, one.preapps_num_pre_xsell, one.preapps_num_pre_cash, one.preapps_num_pre_pos) == (3, 1, 1, 0)
    assert (one.prev_num_lastdue_future, one.prev_num_firstdue_future, one.preapps_num_pre_goods_insured) == (1, None, 1)
    assert (one.prev_most_recent_contract_status, two.prev_most_recent_contract_status) == ("Approved", None)
    assert (one["prev_app_num_cash-loans"], one.prev_num_client_Unknown, one.prev_app_num_approved) == (None, 1, 1)
    assert one.prev__SK_ID_CURR_mean_expected_num_prev_payments == 2.0
    as_one = previous.previous_features(df, null_product=1).orderBy("SK_ID_CURR").collect()
    assert as_one[0].preapps_num_pre_pos == 2 and as_one[1].preapps_num_pre_card == 1


def payment(loan, number, version, paid, due=100.0, day=-100, entry=-100, applicant=1):
    return dict(SK_ID_PREV=loan, SK_ID_CURR=applicant, NUM_INSTALMENT_NUMBER=number, NUM_INSTALMENT_VERSION=version,
                AMT_PAYMENT=paid, AMT_INSTALMENT=due, DAYS_INSTALMENT=day, DAYS_ENTRY_PAYMENT=entry)


def test_loan_features(spark):
    df = table(
        spark,
        "installments_payments",
        payment(1, 1, 1, 0.0, entry=-90),
        payment(1, 2, 1, 130.0, entry=-95),
        payment(1, 3, 2, 60.0, entry=-105),
        payment(1, 4, 2, 80.0),
        payment(1, 4, 3, None, entry=-80),
        payment(2, 1, 1, 100.0),
    )
    for hot_rows in (1, 10**6):
        one, two = instalments.loan_features(df, hot_rows).orderBy("SK_ID_PREV").collect()
        assert (one.number_instalment, one.number_versiona, one.first_instalment, one.last_instalment) == (4, 3, 1, 4)
        assert (one.number_missed_instalment, one.number_missed_versions, one.last_missed_instalment_version) == (1, 1, 1)
        assert (one.number_late_payments, one.first_late_payment_instalment, one.last_late_payment_version) == (2, 2, 3)
        assert (one.number_late_payment_versions, one.number_early_payments, one.number_early_payment_versions) == (2, 1, 1)
        assert (one.max_high_payment, one.max_low_payment, one.min_low_payment) == (30.0, -40.0, -20.0)
        assert (one.sum_low_payment, one.mean_low_payment, one.number_low_payments) == (-60.0, -30.0, 2)
        assert (two.number_late_payments, two.number_missed_instalment, two.max_high_payment) == (None, None, None)
        assert len(one) == 46


def test_late_flag_keeps_its_historical_formula(spark):
    df = table(spark, "installments_payments", payment(1, 1, 1, 1.0, entry=-120), payment(1, 2, 1, 1.0, entry=-80))
    got = {r.NUM_INSTALMENT_NUMBER: (r.diff_days, r.instalment_paid_late) for r in instalments.payment_rows(df).collect()}
    assert got == {1: (20, 1), 2: (-20, 0)}


@pytest.fixture(scope="module")
def payments(spark, sf_dir):
    return credit_table(spark, sf_dir, "installments_payments").cache()


def close(left, right, key):
    left, right = ({tuple(r[k] for k in key): r.asDict() for r in df.collect()} for df in (left, right))
    assert left.keys() == right.keys()
    for k, row in left.items():
        for name, value in row.items():
            other = right[k][name]
            if isinstance(value, float):
                assert other == pytest.approx(value, rel=1e-9, abs=1e-7), (k, name)
            else:
                assert other == value, (k, name)


@pytest.mark.parametrize("plan", ["payment_features", "last_k_features", "loan_features"])
def test_hot_and_usual_keys_give_the_same_features(payments, plan):
    build_features = getattr(instalments, plan)
    key = ["SK_ID_CURR", "SK_ID_PREV"] if plan == "loan_features" else ["SK_ID_CURR"]
    limit = 5 if plan == "loan_features" else 45
    close(build_features(payments), build_features(payments, hot_rows=limit), key)


def test_feature_counts(payments):
    assert len(instalments.payment_features(payments).columns) == 1 + 40 + 31
    assert len(instalments.last_k_features(payments).columns) == 1 + 186
    assert len(instalments.loan_features(payments).columns) == 2 + 44


def test_card(spark):
    base = dict(SK_ID_CURR=1, SK_ID_PREV=1, AMT_CREDIT_LIMIT_ACTUAL=100.0, AMT_BALANCE=50.0, CNT_INSTALMENT_MATURE_CUM=3,
                AMT_DRAWINGS_ATM_CURRENT=4.0, AMT_DRAWINGS_CURRENT=8.0, SK_DPD=2)
    df = table(
        spark,
        "credit_card_balance",
        base,
        base | dict(AMT_BALANCE=80.0, CNT_INSTALMENT_MATURE_CUM=5, AMT_DRAWINGS_ATM_CURRENT=-1.0),
        base | dict(AMT_CREDIT_LIMIT_ACTUAL=200.0, AMT_BALANCE=20.0, SK_DPD=5),
        base | dict(SK_ID_PREV=2, CNT_INSTALMENT_MATURE_CUM=None, AMT_CREDIT_LIMIT_ACTUAL=None),
    )
    row = card.card_features(df).first()
    assert (row.credit_card_number_of_loans, row.credit_card_total_instalments) == (2, 5)
    assert row.credit_card_installments_per_loan == 2.5
    assert row.credit_card_avg_loading_of_credit_limit == pytest.approx((0.8 + 0.1) / 2)
    assert (row.credit_card_drawings_atm, row.credit_card_drawings_total) == (12.0, 32.0)
    assert row.credit_card_average_of_days_past_due == pytest.approx(11 / 4)
    assert row.credit_card_cash_card_ratio == pytest.approx(0.375)
    assert len(row) == 1 + 70 + 8


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """CSV files of all eight tables: three applicants, one of them without any history."""
    root = tmp_path_factory.mktemp("credit")
    values = {T.LongType(): "1", T.IntegerType(): "-5", T.DoubleType(): "2.5", T.StringType(): ""}
    texts = {"CREDIT_ACTIVE": "Active", "STATUS": "0", "NAME_CONTRACT_STATUS": "Approved", "CODE_GENDER": "F"}
    for name, schema in SOURCES.items():
        def row(i):
            cells = {f.name: texts.get(f.name, values[f.dataType]) for f in schema.fields}
            cells |= {"SK_ID_CURR": str(i), "TARGET": str(i % 2), "EXTRA": "9"}
            return [cells[c] for c in header]

        header = [f.name for f in schema.fields] + ["EXTRA"]
        ids = {"application_train": (1, 2), "application_test": (3,)}.get(name, (1, 3))
        with open(root / f"{name}.csv", "w", newline="") as f:
            csv.writer(f).writerows([header, *[row(i) for i in ids]])
    return str(root)


def test_whole_build_from_csv(spark, folder, tmp_path):
    written = build(spark, folder, str(tmp_path / "out"))
    wide = wide_table(load_sources(spark, folder))
    assert written.columns == wide.columns and len(set(wide.columns)) == len(wide.columns)
    got = {r.SK_ID_CURR: r for r in written.collect()}
    assert {k: (r.split, r.TARGET) for k, r in got.items()} == {1: ("train", 1), 2: ("train", 0), 3: ("test", None)}
    assert got[1].bur_num_credits == 1 and got[2].bur_num_credits is None
    assert got[1].EXTRA == 9 and "inst__SK_ID_CURR_mean_EXTRA" in wide.columns
    test = read_csv(spark, str(tmp_path / "out" / "test_csv"))
    assert test.count() == 1 and "TARGET" not in test.columns
    assert split_of(written, "train").count() == 2
    assert written.where(F.col("split") == "train").select("SK_ID_CURR").distinct().count() == 2
