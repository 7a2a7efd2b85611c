"""Previous applications and point-of-sale balances, per applicant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.aggregates import aggregate
from riskloom.functions.scalars import (
    contains_flag, field, flag, known_category, null_if, null_if_in, ratio,
)
from riskloom.operators.joins import attach
from riskloom.operators.latest import latest_one
from riskloom.operators.pivot import pivot_columns
from riskloom.operators.recipe import cross_specs, distinct_counts, recipe_agg, recipe_columns
from riskloom.operators.skew import Clustered, split_hot

APPLICANT = "SK_ID_CURR"
LOAN = "SK_ID_PREV"
PREFIX = "prev__"
POS_PREFIX = "pos__"

# Product flags, output <- text searched for in PRODUCT_COMBINATION.
PRODUCT_FLAGS = {
    "prev_X-sell": "X-Sell",
    "prev_POS_loan": "POS",
    "prev_Cash_loan": "Cash",
    "prev_Card_loan": "Card",
    "prev_street": "Street",
    "prev_no_interest": "without interest",
}
# Flag sums per applicant, output <- flag.
FLAG_SUMS = {
    "preapps_num_pre_xsell": "prev_X-sell",
    "preapps_num_pre_pos": "prev_POS_loan",
    "preapps_num_pre_cash": "prev_Cash_loan",
    "preapps_num_pre_card": "prev_Card_loan",
    "preapps_num_pre_no_interest": "prev_no_interest",
    "preapps_num_pre_goods_insured": "prev_goods_insured",
    "preapps_num_pre_closed_early": "prev_early_paid",
    "preapps_num_pre_closed_late": "prev_late_paid",
}
# Category texts of each counted column and the output of each.
CATEGORY_COUNTS = {
    "NAME_CONTRACT_TYPE": {
        "Cash loans": "prev_app_num_cash-loans",
        "Consumer loans": "prev_app_num_consumer-loans",
        "Revolving loans": "prev_app_num_revolving-loans",
    },
    "NAME_CONTRACT_STATUS": {
        "Approved": "prev_app_num_approved",
        "Canceled": "prev_app_num_canceled",
        "Refused": "prev_app_num_refused",
        "Unused offer": "prev_app_num_un-used",
    },
    "CODE_REJECT_REASON": {
        "CLIENT": "prev_app_num_reject_client",
        "HC": "prev_app_num_reject_HC",
        "LIMIT": "prev_app_num_reject_LIMIT",
        "SCO": "prev_app_num_reject_SCO",
        "SCOFR": "prev_app_num_reject_SCOFR",
        "SYSTEM": "prev_app_num_reject_SYSTEM",
        "VERIF": "prev_app_num_reject_VERIF",
        "XAP": "prev_app_num_reject_XAP",
        "XNA": "prev_app_num_reject_XNA",
    },
    "NAME_CLIENT_TYPE": {
        "New": "prev_num_client_New",
        "Refreshed": "prev_num_client_Refreshed",
        "Repeater": "prev_num_client_Repeater",
        "XNA": "prev_num_client_Unknown",
    },
}
# Columns of the latest application and the output of each.
LATEST = {
    "NAME_CLIENT_TYPE": "prev_most_recent_customer_status",
    "NAME_CONTRACT_STATUS": "prev_most_recent_contract_status",
    "CODE_REJECT_REASON": "prev_most_recent_rejection_reason",
    "NAME_PRODUCT_TYPE": "prev_most_recent_sales_type",
    "NAME_PORTFOLIO": "prev_most_recent_portfolio",
    "NAME_PAYMENT_TYPE": "prev_most_recent_payment_type",
}
# Columns aggregated per applicant.
RECIPE_COLUMNS = (
    "AMT_ANNUITY", "AMT_APPLICATION", "AMT_CREDIT", "AMT_DOWN_PAYMENT", "AMT_GOODS_PRICE",
    "CNT_PAYMENT", "DAYS_DECISION", "HOUR_APPR_PROCESS_START", "RATE_DOWN_PAYMENT",
    "expected_num_prev_payments", "diff_amt_applied_crdited", "diffdays_lastdue_termination",
)
POS_COLUMNS = ("MONTHS_BALANCE", "SK_DPD", "SK_DPD_DEF")
DAYS_PER_PAYMENT = 30


def loan_rows(previous: DataFrame, null_product: int = 0) -> DataFrame:
    """Cleaned previous applications with their row-level flags and differences.

    ``null_product`` is the value of the product flags where the product text is missing.
    """
    cleaned = previous.withColumns(
        {c: known_category(c, list(names)) for c, names in CATEGORY_COUNTS.items() if c != "NAME_CONTRACT_TYPE"}
        | {
            "NAME_CONTRACT_TYPE": known_category(
                null_if("NAME_CONTRACT_TYPE", "XNA"), list(CATEGORY_COUNTS["NAME_CONTRACT_TYPE"])
            ),
            "NAME_CASH_LOAN_PURPOSE": null_if_in("NAME_CASH_LOAN_PURPOSE", ["XNA", "XAP"]),
        }
    )
    first_version, last_due = field("DAYS_LAST_DUE_1ST_VERSION"), field("DAYS_LAST_DUE")
    return cleaned.withColumns(
        {name: contains_flag("PRODUCT_COMBINATION", text, null_product) for name, text in PRODUCT_FLAGS.items()}
        | {
            "expected_num_prev_payments": ratio(-field("DAYS_FIRST_DUE"), F.lit(DAYS_PER_PAYMENT)),
            "prev_goods_insured": flag(field("AMT_CREDIT") > field("AMT_GOODS_PRICE")),
            "prev_early_paid": flag(first_version > last_due),
            "prev_late_paid": flag(first_version < last_due),
            "diffdays_lastdue_termination": field("DAYS_TERMINATION") - last_due,
            "diff_amt_applied_crdited": field("AMT_APPLICATION") - field("AMT_CREDIT"),
        }
    )


def previous_features(previous: DataFrame | Clustered, null_product: int = 0) -> DataFrame:
    """One row per applicant: counts, flag sums, statistics and the latest application."""
    parted = previous if isinstance(previous, Clustered) else split_hot(previous, [APPLICANT])
    loans = parted.select(lambda rows: loan_rows(rows, null_product))
    counts = [
        column
        for category, names in CATEGORY_COUNTS.items()
        for column in pivot_columns(category, names, "count", LOAN)
    ]
    sums = [aggregate("sum", flag_name).alias(out) for out, flag_name in FLAG_SUMS.items()]
    recipe = recipe_columns(cross_specs(RECIPE_COLUMNS), PREFIX + "{keys}_{fn}_{col}", [APPLICANT])
    wide = recipe_agg(loans, [APPLICANT], extra=[*sums, *counts, *recipe])
    distinct = distinct_counts(
        parted if parted.stored else parted.rows,
        [APPLICANT],
        LOAN,
        {
            "preapps_num_credits": None,
            "prev_num_lastdue_future": field("DAYS_LAST_DUE") > 0,
            "prev_num_firstdue_future": field("DAYS_FIRST_DUE") > 0,
        },
    )
    newest = latest_one(loans.rows, [APPLICANT], "DAYS_DECISION", LATEST, tie_break=[LOAN])
    return attach(wide, distinct, newest, on=[APPLICANT])


def pos_features(pos: DataFrame) -> DataFrame:
    """One row per applicant: statistics of the point-of-sale balances."""
    return recipe_agg(pos, [APPLICANT], cross_specs(POS_COLUMNS), POS_PREFIX + "{keys}_{fn}_{col}")
