"""External credits and their monthly status, per applicant."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.aggregates import aggregate
from riskloom.functions.scalars import (
    band_flag, field, flag, known_category, null_below, ratio,
)
from riskloom.operators.joins import attach
from riskloom.operators.pivot import first_occurrence_columns, pivot_columns
from riskloom.operators.recipe import (
    cross_specs, distinct_counts, recipe_agg, recipe_columns,
)
from riskloom.operators.skew import Clustered, split_hot

APPLICANT = "SK_ID_CURR"
CREDIT = "SK_ID_BUREAU"
PREFIX = "bureau__"

# Category texts and the name each one takes in the output columns.
CURRENCIES = {"currency 1": "cur1", "currency 2": "cur2", "currency 3": "cur3", "currency 4": "cur4"}
STATUSES = {"Active": "active", "Bad debt": "bad_debt", "Closed": "closed", "Sold": "sold"}
CREDIT_TYPES = {
    "Another type of loan": "A",
    "Car loan": "Car",
    "Cash loan (non-earmarked)": "Cash",
    "Consumer credit": "Consumer",
    "Credit card": "Card",
    "Interbank credit": "IBCredit",
    "Loan for business development": "BD",
    "Loan for purchase of shares (margin lending)": "Shares",
    "Loan for the purchase of equipment": "Equipment",
    "Loan for working capital replenishment": "WorCap",
    "Microloan": "Micro",
    "Mobile operator loan": "MobileO",
    "Mortgage": "Mortgage",
    "Real estate loan": "RS",
    "Unknown type of loan": "Unknown",
}
MONTH_STATUSES = ("0", "1", "2", "3", "4", "5", "C", "X")

# Cleaning thresholds and day-overdue bands.
MIN_CREDIT_DAYS = -40000
OLD_DAY_COLUMNS = ("DAYS_CREDIT_ENDDATE", "DAYS_CREDIT_UPDATE", "DAYS_ENDDATE_FACT")

# Ratio features of one credit, output = numerator over denominator.
CREDIT_RATIOS = {
    "debt_credit_ratio": ("AMT_CREDIT_SUM_DEBT", "AMT_CREDIT_SUM"),
    "credit_creditlimit_ratio": ("AMT_CREDIT_SUM", "AMT_CREDIT_SUM_LIMIT"),
    "debt_creditlimit_ratio": ("AMT_CREDIT_SUM_DEBT", "AMT_CREDIT_SUM_LIMIT"),
    "overdue_credit_ratio": ("AMT_CREDIT_SUM_OVERDUE", "AMT_CREDIT_SUM"),
    "overdue_debt_ratio": ("AMT_CREDIT_SUM_OVERDUE", "AMT_CREDIT_SUM_DEBT"),
    "overdue_creditlimit_ratio": ("AMT_CREDIT_SUM_OVERDUE", "AMT_CREDIT_SUM_LIMIT"),
    "overdue_annuity_ratio": ("AMT_CREDIT_SUM_OVERDUE", "AMT_ANNUITY"),
    "MaxOverdue_annuity_ratio": ("AMT_CREDIT_MAX_OVERDUE", "AMT_ANNUITY"),
    "sum_overdue_days_overdue_ratio": ("AMT_CREDIT_SUM_OVERDUE", "CREDIT_DAY_OVERDUE"),
    "cnt_prolonged_span_ratio": ("CNT_CREDIT_PROLONG", "span_credit"),
    "sum_overdue_span_ratio": ("AMT_CREDIT_SUM_OVERDUE", "span_credit"),
    "debt_span_ratio": ("AMT_CREDIT_SUM_DEBT", "span_credit"),
}
# Columns of a credit that are aggregated per applicant.
RECIPE_COLUMNS = (
    "AMT_ANNUITY", "AMT_CREDIT_SUM", "AMT_CREDIT_SUM_DEBT", "AMT_CREDIT_SUM_LIMIT",
    "AMT_CREDIT_SUM_OVERDUE", "AMT_CREDIT_MAX_OVERDUE", "CNT_CREDIT_PROLONG", "CREDIT_DAY_OVERDUE",
    "DAYS_CREDIT", "DAYS_CREDIT_ENDDATE", "DAYS_ENDDATE_FACT", "DAYS_CREDIT_UPDATE",
    "debt_credit_ratio", "credit_creditlimit_ratio", "debt_creditlimit_ratio",
    "overdue_credit_ratio", "overdue_debt_ratio", "overdue_creditlimit_ratio",
    "overdue_annuity_ratio", "MaxOverdue_annuity_ratio", "sum_overdue_days_overdue_ratio",
    "cnt_prolonged_days_started_ratio", "span_credit", "cnt_prolonged_span_ratio",
    "sum_overdue_span_ratio",
)
COUNT_SPECS = (
    ("CREDIT_TYPE", "count"),
    ("CREDIT_ACTIVE", "size"),
    ("DPD_past_90", "sum"),
    ("DPD_btwn_60_90", "sum"),
    ("DPD_btwn_30_60", "sum"),
)
# Sums per applicant, output <- column.
APPLICANT_SUMS = {
    "bur_sum_debt": "AMT_CREDIT_SUM_DEBT",
    "bur_sum_creditlimit": "AMT_CREDIT_SUM_LIMIT",
    "bur_sum_credit": "AMT_CREDIT_SUM",
    "bur_sum_overdue": "AMT_CREDIT_SUM_OVERDUE",
    "bur_sum_annuity": "AMT_ANNUITY",
    "bur_sum_cnt_credit_prolongs": "CNT_CREDIT_PROLONG",
}
# Ratios to the applicant's income, output <- numerator.
INCOME_RATIOS = {
    "bur_debt_income_ratio": "bur_sum_debt",
    "bur_annuity_income_ratio": "bur_sum_annuity",
    "bur_overdue_income_ratio": "bur_sum_overdue",
    "bur_credit_income_ratio": "bur_sum_credit",
    "bur_creditlimit_income_ratio": "bur_sum_creditlimit",
    "bur_active_annuity_income_ratio": "bur_active_annuity",
}


# What the ratios to the applicant's income and to the number of credits are made of.
RATIO_INPUTS = (
    "AMT_INCOME_TOTAL", "AMT_ANNUITY", "bur_num_credits", "bur_num_credits_active", "bur_sum_annuity_active",
    *[f"bur_num_past_{s}" for s in STATUSES.values()], *[c for c in INCOME_RATIOS.values() if c != "bur_active_annuity"],
)


def credit_rows(bureau: DataFrame) -> DataFrame:
    """Cleaned credits with their row-level ratios and overdue flags."""
    cleaned = bureau.withColumns(
        {c: null_below(c, MIN_CREDIT_DAYS) for c in OLD_DAY_COLUMNS}
        | {
            "AMT_CREDIT_SUM_LIMIT": null_below("AMT_CREDIT_SUM_LIMIT", 0),
            "CREDIT_ACTIVE": known_category("CREDIT_ACTIVE", list(STATUSES)),
            "CREDIT_CURRENCY": known_category("CREDIT_CURRENCY", list(CURRENCIES)),
            "CREDIT_TYPE": known_category("CREDIT_TYPE", list(CREDIT_TYPES)),
        }
    )
    overdue = field("CREDIT_DAY_OVERDUE")
    spanned = cleaned.withColumn("span_credit", field("DAYS_CREDIT_ENDDATE") - field("DAYS_CREDIT"))
    return spanned.withColumns(
        {name: ratio(num, den) for name, (num, den) in CREDIT_RATIOS.items()}
        | {
            "cnt_prolonged_days_started_ratio": ratio("CNT_CREDIT_PROLONG", -field("DAYS_CREDIT")),
            "DPD_past_90": flag(overdue > 90),
            "DPD_btwn_60_90": band_flag(overdue, 60, 90),
            "DPD_btwn_30_60": band_flag(overdue, 30, 60),
        }
    )


def _values_present(category: str, values: Iterable[str]) -> Column:
    """Distinct values of a closed category list: a sum of marks instead of a distinct count."""
    marks = [F.coalesce(F.max(flag(field(category) == v)), F.lit(0)) for v in values]
    return sum(marks[1:], marks[0]).cast("long")


def bureau_features(bureau: DataFrame | Clustered) -> DataFrame:
    """One row per applicant: credit counts by category, sums and the recipe statistics."""
    parted = bureau if isinstance(bureau, Clustered) else split_hot(bureau, [APPLICANT])
    credits = parted.select(credit_rows)
    ends = field("DAYS_CREDIT_ENDDATE")

    def by_status(template: str) -> dict[str, str]:
        return {value: template.format(name) for value, name in STATUSES.items()}

    counts = [
        *pivot_columns(
            "CREDIT_CURRENCY", {v: f"bur_num_credits_{n}" for v, n in CURRENCIES.items()}, "count", CREDIT
        ),
        *pivot_columns("CREDIT_ACTIVE", by_status("bur_num_credits_{}"), "count", CREDIT),
        *pivot_columns(
            "CREDIT_TYPE", {v: f"bur_num_credits_type{n}" for v, n in CREDIT_TYPES.items()}, "count", CREDIT
        ),
        *pivot_columns("CREDIT_ACTIVE", by_status("bur_num_past_{}"), "count", ends, where=ends < 0),
        *pivot_columns("CREDIT_ACTIVE", by_status("bur_num_future_{}"), "count", ends, where=ends > 0),
        *pivot_columns("CREDIT_ACTIVE", by_status("bur_sum_annuity_{}"), "sum", "AMT_ANNUITY"),
        aggregate("count", "CREDIT_DAY_OVERDUE", field("CREDIT_DAY_OVERDUE") > 90).alias("num_DPD_90"),
    ]
    sums = [aggregate("sum", column).alias(name) for name, column in APPLICANT_SUMS.items()]
    recipe = recipe_columns(
        [*COUNT_SPECS, *cross_specs(RECIPE_COLUMNS)], PREFIX + "{keys}_{fn}_{col}", [APPLICANT]
    )
    diversity = [
        _values_present("CREDIT_TYPE", CREDIT_TYPES).alias("bur_num_credit_types"),
        _values_present("CREDIT_CURRENCY", CURRENCIES).alias("bur_num_currency_types"),
    ]
    wide = recipe_agg(credits, [APPLICANT], extra=[*diversity, *counts, *sums, *recipe])
    return attach(wide, distinct_counts(parted if parted.stored else parted.rows, [APPLICANT], CREDIT, {"bur_num_credits": None}), on=[APPLICANT])


def with_income_ratios(applicants: DataFrame) -> DataFrame:
    """Ratios that need both the applicant's own row and the attached credit features."""
    past = sum((field(f"bur_num_past_{s}") for s in list(STATUSES.values())[1:]), field("bur_num_past_active"))
    total = "bur_num_credits"
    active = applicants.withColumn("bur_active_annuity", field("bur_sum_annuity_active") + field("AMT_ANNUITY"))
    return active.withColumns(
        {name: ratio(num, "AMT_INCOME_TOTAL") for name, num in INCOME_RATIOS.items()}
        | {
            "bur_prop_active_credits": ratio("bur_num_credits_active", total),
            "bur_prop_active_credits_past": ratio("bur_num_past_active", total),
            "bur_prop_credits_past": ratio(past, total),
        }
    )


def balance_per_credit(balance: DataFrame) -> DataFrame:
    """One row per credit: months and first month in each status, number of statuses."""
    month = field("MONTHS_BALANCE")
    known = balance.withColumn("STATUS", known_category("STATUS", list(MONTH_STATUSES)))
    months = pivot_columns("STATUS", {s: f"bubal_num_months_S-{s}" for s in MONTH_STATUSES}, "count", month)
    firsts = first_occurrence_columns(
        "STATUS", {s: f"bubal_first_inst_with_S{s}" for s in MONTH_STATUSES}, month
    )
    different = _values_present("STATUS", MONTH_STATUSES).alias("bubal_num_different_statuses")
    return recipe_agg(known, [CREDIT], extra=[*months, different, *firsts])


def bureau_balance_features(bureau: DataFrame, balance: DataFrame, owners_parted: Clustered | None = None) -> DataFrame:
    """One row per applicant: statistics of the monthly features over the applicant's credits. ``owners_parted`` knows the
    hot applicants of the credits."""
    per_credit = balance_per_credit(balance)
    columns = [c for c in per_credit.columns if c != CREDIT]
    owners = bureau.select(APPLICANT, CREDIT)
    joined = owners.join(per_credit, CREDIT, "left")
    return recipe_agg(joined, [APPLICANT], cross_specs(columns), keys_from=owners_parted or bureau)
