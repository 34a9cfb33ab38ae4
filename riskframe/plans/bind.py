"""Role binding: the loan-table roles the operators were written for, mapped
onto the driver's tables.

A role is a list of ``name = expression`` pairs over one source table (or a
join of two).  The same definitions drive the Spark side (``selectExpr``) and
the DuckDB oracle (a CTE), so both engines see identical inputs.  Only the
day-difference function is spelled differently per engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.sources.tables import read_table

# fixed values: reference date for relative day / month columns
REF_DATE = "2001-12-31"
REF_MONTH_INDEX = 2001 * 12 + 12


def days(col: str, engine: str) -> str:
    """Whole days from REF_DATE to ``col`` (negative = before)."""
    if engine == "spark":
        return f"CAST(datediff(CAST({col} AS DATE), DATE'{REF_DATE}') AS BIGINT)"
    return f"CAST(datediff('day', DATE '{REF_DATE}', CAST({col} AS DATE)) AS BIGINT)"


def months(col: str) -> str:
    return f"(year({col}) * 12 + month({col}) - {REF_MONTH_INDEX})"


def _application(e: str) -> list[tuple[str, str]]:
    return [
        ("SK_ID_CURR", "c_custkey"),
        ("TARGET", "CAST(CASE WHEN c_acctbal < 1000 THEN 1 ELSE 0 END AS BIGINT)"),
        ("AMT_INCOME_TOTAL", "c_acctbal"),
        ("AMT_CREDIT", "c_acctbal * 3e0 + 500e0"),
        ("AMT_ANNUITY", "(c_acctbal + 1000e0) / 12e0"),
        ("AMT_GOODS_PRICE", "CASE WHEN c_nationkey = 0 THEN NULL ELSE c_acctbal * 2.5e0 END"),
        ("CNT_FAM_MEMBERS", "CAST(c_nationkey % 5 AS BIGINT)"),
        ("CNT_CHILDREN", "CAST(c_nationkey % 3 AS BIGINT)"),
        ("DAYS_BIRTH", "-(7000 + (c_custkey * 37) % 18000)"),
        ("DAYS_EMPLOYED", "CASE WHEN c_custkey % 10 = 0 THEN 365243 ELSE -((c_custkey * 13) % 9000) END"),
        ("DAYS_REGISTRATION", "-((c_custkey * 7) % 5000)"),
        ("DAYS_ID_PUBLISH", "-((c_custkey * 11) % 4000)"),
        ("DAYS_LAST_PHONE_CHANGE", "-((c_custkey * 3) % 1500)"),
        ("OWN_CAR_AGE", "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 25 END"),
        ("EXT_SOURCE_1", "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE ((c_custkey * 7919) % 1000) / 1000e0 END"),
        ("EXT_SOURCE_2", "((c_custkey * 104729) % 1000) / 1000e0"),
        ("EXT_SOURCE_3", "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE ((c_custkey * 1299709) % 1000) / 1000e0 END"),
        ("REGION_RATING_CLIENT", "CAST(c_nationkey % 3 + 1 AS BIGINT)"),
        ("REGION_RATING_CLIENT_W_CITY", "CAST((c_nationkey + c_custkey) % 3 + 1 AS BIGINT)"),
        ("FLAG_DOCUMENT_2", "CAST(c_custkey % 2 AS BIGINT)"),
        ("FLAG_DOCUMENT_3", "CAST(CASE WHEN c_custkey % 4 < 2 THEN 1 ELSE 0 END AS BIGINT)"),
        ("FLAG_DOCUMENT_4", "CAST(CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey % 3 % 2 END AS BIGINT)"),
        ("NAME_CONTRACT_TYPE", "c_mktsegment"),
        ("OCCUPATION_TYPE", "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_mktsegment END"),
        ("ORGANIZATION_TYPE", "CONCAT('ORG_', CAST(c_nationkey AS STRING))"),
        ("CODE_GENDER", "CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END"),
    ]


def _bureau(e: str) -> list[tuple[str, str]]:
    return [
        ("SK_ID_BUREAU", "o_orderkey"),
        ("SK_ID_CURR", "o_custkey"),
        ("DAYS_CREDIT", days("o_orderdate", e)),
        ("DAYS_CREDIT_ENDDATE", f"{days('o_orderdate', e)} + CAST(o_orderkey % 720 AS INT)"),
        ("DAYS_CREDIT_UPDATE", f"{days('o_orderdate', e)} + CAST(o_orderkey % 30 AS INT)"),
        ("AMT_CREDIT_SUM", "o_totalprice"),
        ("AMT_CREDIT_SUM_DEBT", "o_totalprice * (o_orderkey % 7) / 10e0"),
        ("AMT_CREDIT_SUM_LIMIT", "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice / 4e0 END"),
        ("AMT_CREDIT_SUM_OVERDUE", "CASE WHEN o_orderstatus = 'P' THEN o_totalprice / 20e0 ELSE 0e0 END"),
        ("AMT_ANNUITY", "o_totalprice / 24e0"),
        ("CREDIT_DAY_OVERDUE", "CAST(o_orderkey % 11 AS BIGINT)"),
        ("CNT_CREDIT_PROLONG", "CAST(o_orderkey % 3 AS BIGINT)"),
        ("CREDIT_ACTIVE", "CASE o_orderstatus WHEN 'F' THEN 'Closed' WHEN 'O' THEN 'Active' ELSE 'Sold' END"),
    ]


def _bureau_balance(e: str) -> list[tuple[str, str]]:
    return [
        ("SK_ID_BUREAU", "l_orderkey"),
        ("MONTHS_BALANCE", f"CAST({months('l_shipdate')} AS BIGINT)"),
        ("STATUS", "CASE WHEN l_returnflag = 'R' THEN 'C' ELSE l_linestatus END"),
    ]


def _previous(e: str) -> list[tuple[str, str]]:
    return [
        ("SK_ID_PREV", "o_orderkey"),
        ("SK_ID_CURR", "o_custkey"),
        ("AMT_ANNUITY", "o_totalprice / 12e0"),
        ("AMT_APPLICATION", "o_totalprice"),
        ("AMT_CREDIT", "o_totalprice * 0.9e0"),
        ("AMT_DOWN_PAYMENT", "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice * 0.1e0 END"),
        ("AMT_GOODS_PRICE", "o_totalprice * 0.95e0"),
        ("DAYS_DECISION", days("o_orderdate", e)),
        ("DAYS_FIRST_DRAWING", f"{days('o_orderdate', e)} + 10"),
        ("DAYS_FIRST_DUE", f"{days('o_orderdate', e)} + 30"),
        ("DAYS_LAST_DUE", f"{days('o_orderdate', e)} + 30 * CAST(o_orderkey % 24 AS INT)"),
        ("DAYS_TERMINATION", f"{days('o_orderdate', e)} + 30 * CAST(o_orderkey % 24 AS INT) + 15"),
        ("RATE_DOWN_PAYMENT", "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 0.1e0 END"),
        ("RATE_INTEREST_PRIMARY", "CASE WHEN o_orderkey % 9 = 0 THEN (o_orderkey % 100) / 500e0 ELSE NULL END"),
        ("RATE_INTEREST_PRIVILEGED", "CASE WHEN o_orderkey % 9 = 0 THEN (o_orderkey % 50) / 400e0 ELSE NULL END"),
        ("CNT_PAYMENT", "CAST(o_orderkey % 48 AS BIGINT)"),
        ("NFLAG_INSURED_ON_APPROVAL", "CAST(CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END AS BIGINT)"),
        ("NAME_CONTRACT_STATUS", "CASE o_orderstatus WHEN 'F' THEN 'Approved' WHEN 'O' THEN 'Refused' ELSE 'Canceled' END"),
    ]


def _installments(e: str) -> list[tuple[str, str]]:
    return [
        ("SK_ID_PREV", "l_orderkey"),
        ("SK_ID_CURR", "o_custkey"),
        ("NUM_INSTALMENT_NUMBER", "CAST(l_linenumber AS BIGINT)"),
        ("NUM_INSTALMENT_VERSION", "CAST(l_suppkey % 4 AS BIGINT)"),
        ("DAYS_INSTALMENT", f"{days('o_orderdate', e)} + 30"),
        ("DAYS_ENTRY_PAYMENT", days("l_shipdate", e)),
        ("AMT_INSTALMENT", "l_extendedprice"),
        ("AMT_PAYMENT", "l_extendedprice * (1e0 - l_discount)"),
    ]


def _pos(e: str) -> list[tuple[str, str]]:
    return [
        ("SK_ID_PREV", "l_orderkey"),
        ("SK_ID_CURR", "o_custkey"),
        ("MONTHS_BALANCE", f"CAST({months('l_shipdate')} AS BIGINT)"),
        ("CNT_INSTALMENT", "l_quantity"),
        ("CNT_INSTALMENT_FUTURE", "l_quantity - l_linenumber"),
        ("SK_DPD", f"CAST(GREATEST({days('l_shipdate', e)} - {days('o_orderdate', e)} - 60, 0) AS BIGINT)"),
        ("SK_DPD_DEF", f"CAST(GREATEST({days('l_shipdate', e)} - {days('o_orderdate', e)} - 90, 0) AS BIGINT)"),
    ]


def _card(e: str) -> list[tuple[str, str]]:
    return [
        ("SK_ID_PREV", "l_orderkey"),
        ("SK_ID_CURR", "o_custkey"),
        ("MONTHS_BALANCE", f"CAST({months('l_shipdate')} AS BIGINT)"),
        ("AMT_BALANCE", "l_extendedprice"),
        ("AMT_CREDIT_LIMIT_ACTUAL", "l_quantity * 1000e0"),
        ("AMT_DRAWINGS_CURRENT", "l_extendedprice * l_discount"),
        ("AMT_DRAWINGS_ATM_CURRENT", "CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice * l_discount ELSE NULL END"),
        ("AMT_DRAWINGS_POS_CURRENT", "CASE WHEN l_linenumber % 2 = 1 THEN l_extendedprice * l_discount ELSE NULL END"),
        ("AMT_PAYMENT_CURRENT", "l_extendedprice * l_tax"),
        ("AMT_PAYMENT_TOTAL_CURRENT", "l_extendedprice * (l_tax + l_discount)"),
        ("AMT_RECEIVABLE_PRINCIPAL", "l_extendedprice * (1e0 - l_discount)"),
        ("AMT_TOTAL_RECEIVABLE", "l_extendedprice * (1e0 - l_discount) * (1e0 + l_tax)"),
        ("CNT_DRAWINGS_CURRENT", "CAST(l_linenumber AS BIGINT)"),
        ("CNT_INSTALMENT_MATURE_CUM", "l_quantity"),
        ("SK_DPD", f"CAST(GREATEST({days('l_shipdate', e)} - {days('o_orderdate', e)} - 60, 0) AS BIGINT)"),
        ("SK_DPD_DEF", f"CAST(GREATEST({days('l_shipdate', e)} - {days('o_orderdate', e)} - 90, 0) AS BIGINT)"),
    ]


# role -> (source tables, definition)
ROLES = {
    "application": (("customer",), _application),
    "bureau": (("orders",), _bureau),
    "bureau_balance": (("lineitem",), _bureau_balance),
    "previous_application": (("orders",), _previous),
    "installments_payments": (("lineitem", "orders"), _installments),
    "POS_CASH_balance": (("lineitem", "orders"), _pos),
    "credit_card_balance": (("lineitem", "orders"), _card),
}

_JOIN = "l_orderkey = o_orderkey"


#: Source columns of the roles, and rows of a partition where rows of one applicant are brought together.
_ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_LINE_COLS = ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
CLUSTER_ROWS = 250_000


def _rows(spark: SparkSession, sf_dir: str, tables: tuple[str, ...]) -> DataFrame:
    if len(tables) == 1:
        return read_table(spark, sf_dir, tables[0])
    li = read_table(spark, sf_dir, "lineitem")
    od = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return li.join(od, li.l_orderkey == od.o_orderkey, "inner")


def clustered_rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The narrow source rows of the child role ``name``, rows of one applicant in one
    partition: a wide rollup then combines them before its shuffle, which moves one
    wide row per applicant, not one per order.  Spark's rebalancing splits a partition
    that one applicant fills, and the rollup's own shuffle merges the parts."""
    tables, _ = ROLES[name]
    rows = _rows(spark, sf_dir, tables).select(*(_ORDER_COLS if tables == ("orders",) else [*_LINE_COLS, "o_custkey", "o_orderdate"]))
    n = read_table(spark, sf_dir, tables[0]).count() // CLUSTER_ROWS + 1
    n = max(n, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.where(F.col("o_custkey").isNotNull()).hint("rebalance", n, F.col("o_custkey"))


def role(spark: SparkSession, sf_dir: str, name: str, rows: DataFrame | None = None) -> DataFrame:
    """The role ``name`` as a Spark DataFrame over the driver tables, or over its
    source ``rows`` where they are at hand."""
    tables, fn = ROLES[name]
    cols = [f"{expr} AS {alias}" for alias, expr in fn("spark")]
    return (_rows(spark, sf_dir, tables) if rows is None else rows).selectExpr(*cols)


def role_sql(name: str) -> str:
    """The same role as a DuckDB sub-query (use as ``WITH x AS (<this>)``)."""
    tables, fn = ROLES[name]
    cols = ", ".join(f"{expr} AS {alias}" for alias, expr in fn("duckdb"))
    if len(tables) == 1:
        return f"SELECT {cols} FROM {tables[0]}"
    return f"SELECT {cols} FROM lineitem JOIN orders ON {_JOIN}"


def with_roles(*names: str) -> str:
    """``WITH`` clause defining the given roles for an oracle query."""
    return "WITH " + ",\n".join(f"{n} AS ({role_sql(n)})" for n in names) + "\n"
