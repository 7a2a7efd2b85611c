"""Schemas of the credit tables: the columns the feature plans use.

Identifiers, counts and day or month offsets are integers, amounts and scores doubles. Every
column but the key may be missing. Further columns of a file pass through with inferred types.
"""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"id": T.LongType(), "int": T.IntegerType(), "num": T.DoubleType(), "text": T.StringType()}


def _schema(**groups: str) -> T.StructType:
    return T.StructType(
        [T.StructField(name, _TYPES[kind]) for kind, names in groups.items() for name in names.split()]
    )


_APPLICATION = {
    "id": "SK_ID_CURR",
    "text": "CODE_GENDER NAME_EDUCATION_TYPE NAME_INCOME_TYPE OCCUPATION_TYPE ORGANIZATION_TYPE",
    "int": "CNT_CHILDREN DAYS_BIRTH DAYS_EMPLOYED DAYS_ID_PUBLISH DAYS_LAST_PHONE_CHANGE "
    "DAYS_REGISTRATION REG_CITY_NOT_WORK_CITY",
    "num": "AMT_ANNUITY AMT_CREDIT AMT_GOODS_PRICE AMT_INCOME_TOTAL AMT_REQ_CREDIT_BUREAU_YEAR "
    "APARTMENTS_AVG BASEMENTAREA_AVG CNT_FAM_MEMBERS ELEVATORS_AVG EXT_SOURCE_1 EXT_SOURCE_2 "
    "EXT_SOURCE_3 NONLIVINGAREA_AVG OWN_CAR_AGE TOTALAREA_MODE YEARS_BUILD_AVG",
}

APPLICATION_TEST = _schema(**_APPLICATION)
APPLICATION_TRAIN = T.StructType(
    [APPLICATION_TEST.fields[0], T.StructField("TARGET", T.IntegerType()), *APPLICATION_TEST.fields[1:]]
)

BUREAU = _schema(
    id="SK_ID_CURR SK_ID_BUREAU",
    text="CREDIT_ACTIVE CREDIT_CURRENCY CREDIT_TYPE",
    int="CNT_CREDIT_PROLONG CREDIT_DAY_OVERDUE DAYS_CREDIT DAYS_CREDIT_ENDDATE DAYS_CREDIT_UPDATE "
    "DAYS_ENDDATE_FACT",
    num="AMT_ANNUITY AMT_CREDIT_MAX_OVERDUE AMT_CREDIT_SUM AMT_CREDIT_SUM_DEBT AMT_CREDIT_SUM_LIMIT "
    "AMT_CREDIT_SUM_OVERDUE",
)

BUREAU_BALANCE = _schema(id="SK_ID_BUREAU", int="MONTHS_BALANCE", text="STATUS")

PREVIOUS_APPLICATION = _schema(
    id="SK_ID_PREV SK_ID_CURR",
    text="CODE_REJECT_REASON NAME_CASH_LOAN_PURPOSE NAME_CLIENT_TYPE NAME_CONTRACT_STATUS "
    "NAME_CONTRACT_TYPE NAME_PAYMENT_TYPE NAME_PORTFOLIO NAME_PRODUCT_TYPE NAME_YIELD_GROUP "
    "PRODUCT_COMBINATION",
    int="CNT_PAYMENT DAYS_DECISION DAYS_FIRST_DUE DAYS_LAST_DUE DAYS_LAST_DUE_1ST_VERSION "
    "DAYS_TERMINATION HOUR_APPR_PROCESS_START",
    num="AMT_ANNUITY AMT_APPLICATION AMT_CREDIT AMT_DOWN_PAYMENT AMT_GOODS_PRICE RATE_DOWN_PAYMENT",
)

POS_CASH_BALANCE = _schema(id="SK_ID_CURR", int="MONTHS_BALANCE SK_DPD SK_DPD_DEF")

INSTALLMENTS_PAYMENTS = _schema(
    id="SK_ID_PREV SK_ID_CURR",
    int="NUM_INSTALMENT_VERSION NUM_INSTALMENT_NUMBER DAYS_INSTALMENT DAYS_ENTRY_PAYMENT",
    num="AMT_INSTALMENT AMT_PAYMENT",
)

CREDIT_CARD_BALANCE = _schema(
    id="SK_ID_PREV SK_ID_CURR",
    int="CNT_DRAWINGS_ATM_CURRENT CNT_DRAWINGS_CURRENT CNT_DRAWINGS_OTHER_CURRENT "
    "CNT_INSTALMENT_MATURE_CUM MONTHS_BALANCE SK_DPD SK_DPD_DEF",
    num="AMT_BALANCE AMT_CREDIT_LIMIT_ACTUAL AMT_DRAWINGS_ATM_CURRENT AMT_DRAWINGS_CURRENT "
    "AMT_DRAWINGS_OTHER_CURRENT AMT_DRAWINGS_POS_CURRENT AMT_PAYMENT_CURRENT",
)

# File stem of each source table.
SOURCES = {
    "application_train": APPLICATION_TRAIN,
    "application_test": APPLICATION_TEST,
    "bureau": BUREAU,
    "bureau_balance": BUREAU_BALANCE,
    "previous_application": PREVIOUS_APPLICATION,
    "POS_CASH_Balance": POS_CASH_BALANCE,
    "installments_payments": INSTALLMENTS_PAYMENTS,
    "credit_card_balance": CREDIT_CARD_BALANCE,
}
