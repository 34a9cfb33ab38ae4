"""Relational loan-table rollups (one wide feature row per applicant).

The column specs below are the reference feature definitions (names and
statistics); the machinery is the generic ``agg_spec``.  Each rollup is one
``groupBy(SK_ID_CURR).agg(...)``; the mart joins them to the parent on the
same key so the aggregated sides are already hash-partitioned by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.exprs import flag, safe_div
from riskframe.operators.rollup import agg_spec, fit_vocabulary, pivot_count_exprs

KEY = "SK_ID_CURR"

# fixed values: rollup specifications (column -> statistics) per child table
BUREAU_SPEC = {
    "SK_ID_BUREAU": ["count"],
    "DAYS_CREDIT": ["min", "max", "mean"],
    "DAYS_CREDIT_ENDDATE": ["min", "max", "mean"],
    "DAYS_CREDIT_UPDATE": ["min", "max", "mean"],
    "AMT_CREDIT_SUM": ["sum", "mean", "max"],
    "AMT_CREDIT_SUM_DEBT": ["sum", "mean", "max"],
    "AMT_CREDIT_SUM_LIMIT": ["sum", "mean", "max"],
    "AMT_CREDIT_SUM_OVERDUE": ["sum", "mean", "max"],
    "AMT_ANNUITY": ["sum", "mean", "max"],
    "CREDIT_DAY_OVERDUE": ["sum", "mean", "max"],
    "CNT_CREDIT_PROLONG": ["sum", "mean", "max"],
}
PREVIOUS_SPEC = {
    "SK_ID_PREV": ["count"],
    "AMT_ANNUITY": ["min", "max", "mean"],
    "AMT_APPLICATION": ["min", "max", "mean", "sum"],
    "AMT_CREDIT": ["min", "max", "mean", "sum"],
    "AMT_DOWN_PAYMENT": ["min", "max", "mean", "sum"],
    "AMT_GOODS_PRICE": ["min", "max", "mean", "sum"],
    "DAYS_DECISION": ["min", "max", "mean"],
    "DAYS_FIRST_DRAWING": ["min", "max", "mean"],
    "DAYS_FIRST_DUE": ["min", "max", "mean"],
    "DAYS_LAST_DUE": ["min", "max", "mean"],
    "DAYS_TERMINATION": ["min", "max", "mean"],
    "RATE_DOWN_PAYMENT": ["min", "max", "mean"],
    "RATE_INTEREST_PRIMARY": ["min", "max", "mean"],
    "RATE_INTEREST_PRIVILEGED": ["min", "max", "mean"],
    "CNT_PAYMENT": ["min", "max", "mean", "sum"],
    "NFLAG_INSURED_ON_APPROVAL": ["mean", "sum"],
}
POS_SPEC = {
    "SK_ID_PREV": ["count"],
    "MONTHS_BALANCE": ["min", "max", "mean"],
    "CNT_INSTALMENT": ["min", "max", "mean", "sum"],
    "CNT_INSTALMENT_FUTURE": ["min", "max", "mean", "sum"],
    "SK_DPD": ["min", "max", "mean", "sum"],
    "SK_DPD_DEF": ["min", "max", "mean", "sum"],
}
CARD_SPEC = {
    "SK_ID_PREV": ["count"],
    "MONTHS_BALANCE": ["min", "max", "mean"],
    "AMT_BALANCE": ["min", "max", "mean"],
    "AMT_CREDIT_LIMIT_ACTUAL": ["min", "max", "mean"],
    "AMT_DRAWINGS_CURRENT": ["min", "max", "mean", "sum"],
    "AMT_DRAWINGS_ATM_CURRENT": ["sum", "mean"],
    "AMT_DRAWINGS_POS_CURRENT": ["sum", "mean"],
    "AMT_PAYMENT_CURRENT": ["min", "max", "mean", "sum"],
    "AMT_PAYMENT_TOTAL_CURRENT": ["min", "max", "mean", "sum"],
    "AMT_RECEIVABLE_PRINCIPAL": ["min", "max", "mean", "sum"],
    "AMT_TOTAL_RECEIVABLE": ["min", "max", "mean", "sum"],
    "CNT_DRAWINGS_CURRENT": ["min", "max", "mean", "sum"],
    "CNT_INSTALMENT_MATURE_CUM": ["min", "max", "mean", "sum"],
    "SK_DPD": ["min", "max", "mean", "sum"],
    "SK_DPD_DEF": ["min", "max", "mean", "sum"],
}
INSTALLMENT_SPEC = {
    "SK_ID_PREV": ["count"],
    "NUM_INSTALMENT_NUMBER": ["min", "max"],
    "NUM_INSTALMENT_VERSION": ["nunique"],
    "DAYS_INSTALMENT": ["min", "max", "mean"],
    "DAYS_ENTRY_PAYMENT": ["min", "max", "mean"],
    "AMT_INSTALMENT": ["min", "max", "mean", "sum"],
    "AMT_PAYMENT": ["min", "max", "mean", "sum"],
    "PAYMENT_DIFF": ["min", "max", "mean", "sum"],
    "PAYMENT_RATIO": ["min", "max", "mean"],
    "DPD": ["min", "max", "mean"],
    "IS_LATE": ["sum", "mean"],
}
BALANCE_CLOSED_STATUS = "C"


def rollup_balance(bb: DataFrame, key: str = "SK_ID_BUREAU", months: str = "MONTHS_BALANCE",
                   status: str = "STATUS", closed=BALANCE_CLOSED_STATUS) -> DataFrame:
    """Grandchild rollup: month range, row count, closed-status count per bureau id.

    The reference merges 1M-row chunk partials by hand; here the partial and
    final aggregation are Spark's own (independent of split count).
    """
    return (bb.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.min(months).alias("BB_MONTHS_MIN"),
        F.max(months).alias("BB_MONTHS_MAX"),
        F.count(F.lit(1)).alias("BB_COUNT"),
        F.count_if(F.col(status) == F.lit(closed)).alias("BB_STATUS_CLOSED_COUNT")))


def two_level_rollup(bureau: DataFrame, bb: DataFrame, key: str = "SK_ID_BUREAU") -> DataFrame:
    """bureau LEFT JOIN rollup(bureau_balance): one row per bureau record.

    The grandchild is always aggregated before the join (no fan-out)."""
    return bureau.join(rollup_balance(bb, key), on=key, how="left")


def rollup_bureau(bureau: DataFrame, status_vocab=None, status_col: str = "CREDIT_ACTIVE") -> DataFrame:
    vocab = status_vocab if status_vocab is not None else fit_vocabulary(bureau, status_col)
    out = agg_spec(bureau, KEY, "BUREAU", BUREAU_SPEC, extra=pivot_count_exprs(
        status_col, vocab, "BUREAU_CREDIT", "{prefix}_{value}_COUNT"))
    return out.withColumns({
        "BUREAU_DEBT_TO_CREDIT_RATIO": safe_div("BUREAU_AMT_CREDIT_SUM_DEBT_SUM", "BUREAU_AMT_CREDIT_SUM_SUM", 1.0),
        "BUREAU_OVERDUE_RATIO": safe_div("BUREAU_AMT_CREDIT_SUM_OVERDUE_SUM", "BUREAU_AMT_CREDIT_SUM_SUM", 1.0)})


def rollup_previous(prev: DataFrame, status_vocab=None, status_col: str = "NAME_CONTRACT_STATUS") -> DataFrame:
    vocab = status_vocab if status_vocab is not None else fit_vocabulary(prev, status_col)
    out = agg_spec(prev, KEY, "PREV", PREVIOUS_SPEC, extra=pivot_count_exprs(
        status_col, vocab, "PREV_STATUS", "{prefix}_{value}_COUNT"))
    out = out.withColumn("PREV_APP_CREDIT_RATIO",
                         safe_div("PREV_AMT_APPLICATION_MEAN", "PREV_AMT_CREDIT_MEAN", 1.0))
    if "Approved" in vocab:
        out = out.withColumn("PREV_APPROVAL_RATE",
                             safe_div("PREV_STATUS_APPROVED_COUNT", "PREV_SK_ID_PREV_COUNT", 1.0))
    return out


def rollup_pos(pos: DataFrame) -> DataFrame:
    return agg_spec(pos, KEY, "POS", POS_SPEC)


def rollup_card(cc: DataFrame) -> DataFrame:
    out = agg_spec(cc, KEY, "CC", CARD_SPEC)
    return out.withColumns({
        "CC_BALANCE_TO_LIMIT_RATIO": safe_div("CC_AMT_BALANCE_MEAN", "CC_AMT_CREDIT_LIMIT_ACTUAL_MEAN", 1.0),
        "CC_DRAWING_TO_LIMIT_RATIO": safe_div("CC_AMT_DRAWINGS_CURRENT_MEAN", "CC_AMT_CREDIT_LIMIT_ACTUAL_MEAN", 1.0)})


def installment_terms(inst: DataFrame) -> DataFrame:
    """Row-level payment terms derived before the rollup."""
    return (inst
            .withColumn("PAYMENT_DIFF", F.col("AMT_PAYMENT") - F.col("AMT_INSTALMENT"))
            .withColumn("PAYMENT_RATIO", safe_div("AMT_PAYMENT", "AMT_INSTALMENT", 1.0))
            .withColumn("DPD", F.col("DAYS_ENTRY_PAYMENT") - F.col("DAYS_INSTALMENT"))
            .withColumn("IS_LATE", flag(F.col("DAYS_ENTRY_PAYMENT") - F.col("DAYS_INSTALMENT") > 0)))


def rollup_installments(inst: DataFrame) -> DataFrame:
    out = agg_spec(installment_terms(inst), KEY, "INST", INSTALLMENT_SPEC)
    return out.withColumn("INST_LATE_PAYMENT_RATIO", F.col("INST_IS_LATE_MEAN"))


def feature_mart(app: DataFrame, children: list[DataFrame], key: str = KEY) -> DataFrame:
    """Parent LEFT JOIN every child rollup on the entity key (1:1 per rollup).

    Rollups are one row per key, so no join can fan out; each rollup's
    output partitioning (hash on ``key``) satisfies the join's distribution.
    """
    out = app
    for c in children:
        out = out.join(c, on=key, how="left")
    return out
