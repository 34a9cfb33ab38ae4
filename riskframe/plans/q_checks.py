"""Validators and profiles bound to the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.operators import checks as C
from riskframe.plans.bind import _application, role, with_roles
from riskframe.plans.registry import query
from riskframe.plans.sqlgen import rnd_sql, round_double_cols

ORACLE: dict[str, str] = {}
APP = with_roles("application")
APP_COLS = [n for n, _ in _application("duckdb")]
LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def reg(k, s):
    ORACLE[k] = s


def _li(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet")


@query("validate_schema")
def q_validate_schema(spark, d):
    return C.validate_schema(role(spark, d, "application"), ["SK_ID_CURR", "TARGET", "AMT_CREDIT"],
                             ["EXT_SOURCE_1", "NOT_A_COLUMN"])


@query("schema_report")
def q_schema_report(spark, d):
    return C.schema_report(role(spark, d, "application"), APP_COLS[:20] + ["EXPECTED_BUT_ABSENT"])


@query("validate_ids")
def q_validate_ids(spark, d):
    li = _li(spark, d).select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("line_id"))
    return C.validate_ids(li, "line_id")


reg("validate_ids", (
    "WITH ids AS (SELECT l_orderkey * 100 + l_linenumber AS line_id FROM lineitem), "
    "c AS (SELECT line_id, COUNT(*) AS n FROM ids GROUP BY line_id) "
    "SELECT CAST(SUM(n) AS BIGINT) AS n_rows, CAST(COALESCE(SUM(CASE WHEN line_id IS NULL THEN n END), 0) AS BIGINT) AS n_null, "
    "CAST(SUM(n - 1) AS BIGINT) AS n_duplicates, "
    "(SELECT list_sort(list(line_id)) FROM (SELECT line_id FROM c WHERE n > 1 AND line_id IS NOT NULL ORDER BY line_id LIMIT 5)) AS first_duplicates, "
    "COALESCE(SUM(CASE WHEN line_id IS NULL THEN n END), 0) = 0 AND SUM(n - 1) = 0 AS is_valid FROM c"))


@query("validate_target")
def q_validate_target(spark, d):
    return C.validate_target(role(spark, d, "application"), "TARGET")


reg("validate_target", APP + (
    "SELECT COUNT(*) AS n_rows, CAST(COUNT_IF(TARGET IS NULL) AS BIGINT) AS n_null, "
    "CAST(COUNT_IF(TARGET IS NOT NULL AND TARGET NOT IN (0, 1)) AS BIGINT) AS n_invalid, "
    "CAST(COUNT_IF(TARGET = 0) AS BIGINT) AS n_class_0, CAST(COUNT_IF(TARGET = 1) AS BIGINT) AS n_class_1, "
    "COUNT_IF(TARGET IS NULL) = 0 AND COUNT_IF(TARGET NOT IN (0, 1)) = 0 AND COUNT(*) > 0 AS is_valid FROM application"))


@query("validate_proba")
def q_validate_proba(spark, d):
    s = _li(spark, d).select((F.col("l_extendedprice") / F.lit(100000.0)).alias("p"))
    return round_double_cols(C.validate_proba(s, "p"))


reg("validate_proba", (
    "WITH s AS (SELECT l_extendedprice / 100000e0 AS p FROM lineitem) "
    "SELECT COUNT(*) AS n_rows, CAST(COUNT_IF(isnan(p)) AS BIGINT) AS n_nan, CAST(COUNT_IF(isinf(p)) AS BIGINT) AS n_inf, "
    "CAST(COUNT_IF(isfinite(p) AND (p < 0 OR p > 1)) AS BIGINT) AS n_out_of_range, "
    f"{rnd_sql('MIN(CASE WHEN isfinite(p) THEN p END)')} AS min_value, {rnd_sql('MAX(CASE WHEN isfinite(p) THEN p END)')} AS max_value, "
    "COUNT_IF(isnan(p)) + COUNT_IF(isinf(p)) + COUNT_IF(isfinite(p) AND (p < 0 OR p > 1)) = 0 AND COUNT(*) > 0 AS is_valid FROM s"))


@query("finite_guard")
def q_finite_guard(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return C.finite_guard(e, "vec_id", "embedding", 64)


reg("finite_guard", (
    "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n_values, "
    "CAST(len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) AS BIGINT) AS n_non_finite, "
    "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AS is_valid "
    "FROM embeddings"))

CONST_COLS = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipmode_c"]


def _li_const(spark, d):
    # l_shipmode_c: a constant string column derived from the table (exercises the categorical rule)
    return _li(spark, d).withColumn("l_shipmode_c", F.lit("TRUCK"))


@query("constant_features")
def q_constant_features(spark, d):
    return round_double_cols(C.constant_features(_li_const(spark, d), CONST_COLS))


reg("constant_features", (
    "WITH li AS (SELECT *, 'TRUCK' AS l_shipmode_c FROM lineitem) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, 'numeric' AS kind, {rnd_sql(f'STDDEV_SAMP(CAST({c} AS DOUBLE))')} AS stat, "
        f"COALESCE(STDDEV_SAMP(CAST({c} AS DOUBLE)) < 1e-10, true) AS is_constant FROM li" for c in LI_NUM[:0] + ["l_quantity", "l_discount", "l_tax"])
    + " UNION ALL "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, 'categorical' AS kind, {rnd_sql('MAX(n) / SUM(n)')} AS stat, MAX(n) / SUM(n) >= 0.99e0 AS is_constant "
        f"FROM (SELECT {c} AS v, COUNT(*) AS n FROM li WHERE {c} IS NOT NULL GROUP BY {c}) g" for c in CONST_COLS[3:])))


@query("missing_profile")
def q_missing_profile(spark, d):
    return round_double_cols(C.missing_profile(role(spark, d, "application")))


def _miss_union(expr_pct, extra=""):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {expr_pct.format(c=c)} FROM application" for c in APP_COLS)


reg("missing_profile", APP + _miss_union(
    "CAST(COUNT_IF({c} IS NULL) AS BIGINT) AS missing_count, "
    + rnd_sql("COUNT_IF({c} IS NULL) * 100e0 / COUNT(*)") + " AS missing_pct, "
    "CASE WHEN COUNT_IF({c} IS NULL) * 100e0 / COUNT(*) > 50 THEN 'HIGH' WHEN COUNT_IF({c} IS NULL) * 100e0 / COUNT(*) > 20 "
    "THEN 'MEDIUM' ELSE 'LOW' END AS severity"))


@query("missing_rate")
def q_missing_rate(spark, d):
    return C.missing_rate(role(spark, d, "application"))


reg("missing_rate", APP + _miss_union("round_even(COUNT_IF({c} IS NULL) * 100e0 / COUNT(*), 2) AS missing_rate"))


@query("quality_summary")
def q_quality_summary(spark, d):
    return round_double_cols(C.quality_summary(role(spark, d, "application")))


_NUMERIC_APP = [c for c in APP_COLS if c not in ("NAME_CONTRACT_TYPE", "OCCUPATION_TYPE", "ORGANIZATION_TYPE", "CODE_GENDER")]
_MISS_SUM = " + ".join(f"COUNT_IF({c} IS NULL)" for c in APP_COLS)
reg("quality_summary", APP + (
    f"SELECT COUNT(*) AS n_rows, CAST({len(APP_COLS)} AS BIGINT) AS n_cols, CAST({_MISS_SUM} AS BIGINT) AS n_missing_cells, "
    f"{rnd_sql(f'({_MISS_SUM}) * 100e0 / (COUNT(*) * {len(APP_COLS)})')} AS missing_pct, "
    f"CAST({len(_NUMERIC_APP)} AS BIGINT) AS n_numeric_cols, CAST({len(APP_COLS) - len(_NUMERIC_APP)} AS BIGINT) AS n_other_cols, "
    "COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM application)) AS n_duplicate_rows FROM application"))


@query("quality_report")
def q_quality_report(spark, d):
    return round_double_cols(C.quality_report(role(spark, d, "application"), target="TARGET"))


def _qr_sql():
    nu = " UNION ALL ".join(f"SELECT '{c}' AS col, CAST(COUNT(DISTINCT {c}) AS DOUBLE) AS v FROM application" for c in APP_COLS)
    inf = " UNION ALL ".join(
        f"SELECT '{c}' AS col, CAST(COUNT_IF(isinf(CAST({c} AS DOUBLE))) AS DOUBLE) AS v FROM application" for c in _NUMERIC_APP)
    hc = ", ".join(f"'{c}'" for c in APP_COLS if c not in _NUMERIC_APP)
    return APP + (
        f"SELECT 'constant' AS \"check\", col AS \"column\", {rnd_sql('v')} AS value FROM ({nu}) a WHERE v <= 1 "
        f"UNION ALL SELECT 'high_cardinality', col, {rnd_sql('v')} FROM ({nu}) b WHERE col IN ({hc}) AND v > 50 "
        f"UNION ALL SELECT 'infinite', col, {rnd_sql('v')} FROM ({inf}) c WHERE v > 0 "
        f"UNION ALL SELECT 'duplicate_rows', NULL, {rnd_sql('CAST(COALESCE(SUM(n - 1), 0) AS DOUBLE)')} FROM "
        f"(SELECT COUNT(*) AS n FROM application GROUP BY {', '.join(APP_COLS)}) g "
        f"UNION ALL SELECT 'rare_class', CAST(TARGET AS VARCHAR), {rnd_sql('n / t')} FROM "
        f"(SELECT TARGET, COUNT(*) AS n, SUM(COUNT(*)) OVER () AS t FROM application GROUP BY TARGET) r WHERE n / t < 0.01e0")


reg("quality_report", _qr_sql())

EV_REF = "ts < TIMESTAMP '2024-01-16 00:00:00'"


def _ev_split(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet")
    ref = ev.where(F.col("ts") < F.lit("2024-01-16 00:00:00").cast("timestamp"))
    cur = ev.where(F.col("ts") >= F.lit("2024-01-16 00:00:00").cast("timestamp")).withColumn(
        "value", F.col("value") * F.lit(1.2))
    return ref, cur


@query("out_of_range")
def q_out_of_range(spark, d):
    ref, cur = _ev_split(spark, d)
    return round_double_cols(C.out_of_range(ref, cur, ["value", "user_id"]))


def _oor_sql():
    parts = []
    for c in ["value", "user_id"]:
        parts.append(
            f"SELECT '{c}' AS feature, COUNT(*) AS n_values, CAST(COUNT_IF(x < lo OR x > hi) AS BIGINT) AS n_out_of_range, "
            f"{rnd_sql('COUNT_IF(x < lo OR x > hi) * 100e0 / COUNT(*)')} AS pct_out_of_range, "
            f"CASE WHEN COUNT_IF(x < lo OR x > hi) * 100e0 / COUNT(*) < 5 THEN 'OK' ELSE 'WARNING' END AS status "
            f"FROM (SELECT CAST({c} AS DOUBLE) AS x FROM cur WHERE {c} IS NOT NULL), "
            f"(SELECT MIN(CAST({c} AS DOUBLE)) AS lo, MAX(CAST({c} AS DOUBLE)) AS hi FROM ref)")
    return (f"WITH ref AS (SELECT * FROM events WHERE {EV_REF}), cur AS (SELECT * EXCLUDE (value), value * 1.2e0 AS value "
            f"FROM events WHERE NOT ({EV_REF})) " + " UNION ALL ".join(parts))


reg("out_of_range", _oor_sql())

# fixed values: per-feature plausibility ranges of the scoring service
RANGE_RULES = {
    "DAYS_BIRTH": (-25550, -6570),
    "AMT_INCOME_TOTAL": (0.0, 10000000.0),
    "AMT_CREDIT": (0.0, 50000000.0),
    "EXT_SOURCE_1": (0.0, 1.0),
    "EXT_SOURCE_2": (0.0, 1.0),
    "EXT_SOURCE_3": (0.0, 1.0),
    "CNT_CHILDREN": (0, 20),
}


@query("range_rules")
def q_range_rules(spark, d):
    return round_double_cols(C.range_rules(role(spark, d, "application"), RANGE_RULES, "SK_ID_CURR"))


reg("range_rules", APP + "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST(COUNT_IF({c} < {lo} OR {c} > {hi}) AS BIGINT) AS n_violations, "
    f"MIN(CASE WHEN {c} < {lo} OR {c} > {hi} THEN SK_ID_CURR END) AS example_key, "
    f"{rnd_sql(f'MIN(CASE WHEN {c} < {lo} OR {c} > {hi} THEN CAST({c} AS DOUBLE) END)')} AS example_value, "
    f"{rnd_sql(repr(float(lo)) + 'e0' if 'e' not in repr(float(lo)) else repr(float(lo)))} AS rule_min, "
    f"{rnd_sql(repr(float(hi)) + 'e0' if 'e' not in repr(float(hi)) else repr(float(hi)))} AS rule_max FROM application"
    for c, (lo, hi) in RANGE_RULES.items()) + ") r WHERE n_violations > 0")


@query("outliers_iqr")
def q_outliers_iqr(spark, d):
    return round_double_cols(C.outliers_iqr(_li(spark, d), LI_NUM))


reg("outliers_iqr", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {rnd_sql('q1')} AS q1, {rnd_sql('q3')} AS q3, {rnd_sql('q1 - 1.5e0 * (q3 - q1)')} AS lower, "
    f"{rnd_sql('q3 + 1.5e0 * (q3 - q1)')} AS upper, "
    f"(SELECT CAST(COUNT_IF({c} < q1 - 1.5e0 * (q3 - q1) OR {c} > q3 + 1.5e0 * (q3 - q1)) AS BIGINT) FROM lineitem) AS n_outliers, "
    f"{rnd_sql(f'(SELECT COUNT_IF({c} < q1 - 1.5e0 * (q3 - q1) OR {c} > q3 + 1.5e0 * (q3 - q1)) FROM lineitem) * 100e0 / n')} AS pct_outliers "
    f"FROM (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3, "
    f"COUNT(*) AS n FROM lineitem) q" for c in LI_NUM))


@query("outliers_z")
def q_outliers_z(spark, d):
    return round_double_cols(C.outliers_z(_li(spark, d), LI_NUM))


reg("outliers_z", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {rnd_sql('m')} AS mean, {rnd_sql('s')} AS std, "
    f"(SELECT CAST(COUNT_IF(abs(({c} - m) / NULLIF(s, 0)) > 3) AS BIGINT) FROM lineitem) AS n_outliers "
    f"FROM (SELECT AVG(CAST({c} AS DOUBLE)) AS m, STDDEV_SAMP(CAST({c} AS DOUBLE)) AS s FROM lineitem) q" for c in LI_NUM))


@query("orphan_ids")
def q_orphan_ids(spark, d):
    cust = spark.read.parquet(f"{d}/customer.parquet").where(F.col("c_acctbal") >= 0)  # open accounts
    orders = spark.read.parquet(f"{d}/orders.parquet")
    li = _li(spark, d)
    open_orders = orders.join(cust, orders.o_custkey == cust.c_custkey, "left_semi")
    out = C.orphan_ids(cust, "c_custkey", {"orders": (orders, "o_custkey")})
    return out.unionByName(C.orphan_ids(open_orders, "o_orderkey", {"lineitem": (li, "l_orderkey")}))


reg("orphan_ids", (
    "WITH cust AS (SELECT * FROM customer WHERE c_acctbal >= 0), "
    "oo AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM cust)) "
    "SELECT 'orders' AS \"table\", COUNT(DISTINCT o_custkey) AS n_child_ids, "
    "COUNT(DISTINCT CASE WHEN o_custkey NOT IN (SELECT c_custkey FROM cust) THEN o_custkey END) AS n_orphan_ids FROM orders "
    "UNION ALL SELECT 'lineitem', COUNT(DISTINCT l_orderkey), "
    "COUNT(DISTINCT CASE WHEN l_orderkey NOT IN (SELECT o_orderkey FROM oo) THEN l_orderkey END) FROM lineitem"))


def _cust_years(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    a = o.where(F.year("o_orderdate") == 1995).select(F.col("o_custkey").alias("cust"))
    b = o.where(F.year("o_orderdate") == 2001).select(F.col("o_custkey").alias("cust"))
    return a, b


@query("id_overlap")
def q_id_overlap(spark, d):
    a, b = _cust_years(spark, d)
    return C.id_overlap(a, b, "cust")


reg("id_overlap", (
    "WITH a AS (SELECT DISTINCT o_custkey AS cust FROM orders WHERE year(o_orderdate) = 1995), "
    "b AS (SELECT DISTINCT o_custkey AS cust FROM orders WHERE year(o_orderdate) = 2001), "
    "both_ AS (SELECT cust FROM a WHERE cust IN (SELECT cust FROM b)) "
    "SELECT COUNT(*) AS n_overlap, (SELECT list_sort(list(cust)) FROM (SELECT cust FROM both_ ORDER BY cust LIMIT 5)) "
    "AS first_overlap FROM both_"))

SUMMARY_TABLES = {"customer": "c_custkey", "orders": "o_orderkey", "lineitem": None, "part": "p_partkey",
                  "supplier": "s_suppkey", "events": "event_id", "labels": "doc_id"}


@query("table_summary")
def q_table_summary(spark, d):
    return C.table_summary({t: (spark.read.parquet(f"{d}/{t}.parquet"), k) for t, k in SUMMARY_TABLES.items()})


_NCOLS = {"customer": 5, "orders": 6, "lineitem": 11, "part": 6, "supplier": 4, "events": 6, "labels": 3}
reg("table_summary", " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", COUNT(*) AS n_rows, CAST({_NCOLS[t]} AS BIGINT) AS n_cols, {str(bool(k)).lower()} AS has_id, "
    + (f"COUNT(DISTINCT {k})" if k else "CAST(NULL AS BIGINT)") + f" AS n_distinct_ids FROM {t}"
    for t, k in SUMMARY_TABLES.items()))


@query("id_presence")
def q_id_presence(spark, d):
    cust = spark.read.parquet(f"{d}/customer.parquet").where(F.col("c_mktsegment") == "BUILDING")
    return C.id_presence(cust, "c_custkey", {
        "orders": (spark.read.parquet(f"{d}/orders.parquet"), "o_custkey"),
        "events": (spark.read.parquet(f"{d}/events.parquet"), "user_id")})


reg("id_presence", (
    "WITH ids AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey IS NOT NULL) "
    "SELECT 'orders' AS \"table\", CAST(COUNT_IF(k IN (SELECT o_custkey FROM orders)) AS BIGINT) AS n_found, COUNT(*) AS n_ids, "
    "CAST(COUNT(*) - COUNT_IF(k IN (SELECT o_custkey FROM orders)) AS BIGINT) AS n_missing FROM ids UNION ALL "
    "SELECT 'events', CAST(COUNT_IF(k IN (SELECT user_id FROM events)) AS BIGINT), COUNT(*), "
    "CAST(COUNT(*) - COUNT_IF(k IN (SELECT user_id FROM events)) AS BIGINT) FROM ids"))

EXPECTED = ["AMT_CREDIT", "EXT_SOURCE_1", "FEATURE_NOT_IN_BATCH", "AMT_INCOME_TOTAL", "DAYS_BIRTH"]


@query("align_features")
def q_align(spark, d):
    return round_double_cols(C.align_features(role(spark, d, "application"), EXPECTED, ["SK_ID_CURR"]))


reg("align_features", APP + (
    f"SELECT SK_ID_CURR, {rnd_sql('AMT_CREDIT')} AS AMT_CREDIT, {rnd_sql('EXT_SOURCE_1')} AS EXT_SOURCE_1, "
    f"0e0 AS FEATURE_NOT_IN_BATCH, {rnd_sql('AMT_INCOME_TOTAL')} AS AMT_INCOME_TOTAL, DAYS_BIRTH FROM application"))


@query("drop_sparse")
def q_drop_sparse(spark, d):
    prev = role(spark, d, "previous_application")
    return round_double_cols(C.drop_sparse(prev, prev))


def _drop_sparse_sql():
    from riskframe.plans.bind import _previous as P
    cols = P("duckdb")
    sparse = {"RATE_INTEREST_PRIMARY", "RATE_INTEREST_PRIVILEGED"}  # 8 of 9 rows missing by construction
    ints = {"SK_ID_PREV", "SK_ID_CURR", "DAYS_DECISION", "DAYS_FIRST_DRAWING", "DAYS_FIRST_DUE", "DAYS_LAST_DUE",
            "DAYS_TERMINATION", "CNT_PAYMENT", "NFLAG_INSURED_ON_APPROVAL", "NAME_CONTRACT_STATUS"}
    sel = [(n if n in ints else f"{rnd_sql(n)} AS {n}") for n, _ in cols if n not in sparse]
    return with_roles("previous_application") + f"SELECT {', '.join(sel)} FROM previous_application"


reg("drop_sparse", _drop_sparse_sql())


@query("quality_gate")
def q_quality_gate(spark, d):
    return C.quality_gate(role(spark, d, "application"), APP_COLS[:24] + ["EXPECTED_BUT_ABSENT"])


def _gate_sql():
    cols = APP_COLS[:24]
    prof = " UNION ALL ".join(f"SELECT '{c}' AS f, COUNT_IF({c} IS NULL) * 100e0 / COUNT(*) AS pct FROM application" for c in cols)
    return APP + (
        f"SELECT COUNT(*) AS n_bad_columns, COALESCE(list_sort(list(f)), []) AS bad_columns, CAST(1 AS BIGINT) AS n_missing_columns, "
        "false AS is_valid, 'INVALID; ' || printf('%d columns above %.0f%% missing', COUNT(*), 20e0) || '; 1 expected columns absent' AS summary "
        f"FROM ({prof}) p WHERE pct > 20")


reg("quality_gate", _gate_sql())


@query("semi_filter")
def q_semi_filter(spark, d):
    li = _li(spark, d)
    fin = spark.read.parquet(f"{d}/orders.parquet").where(F.col("o_orderstatus") == "F")
    return li.join(fin, li.l_orderkey == fin.o_orderkey, "left_semi").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


reg("semi_filter", (
    "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem "
    "WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')"))


@query("page_by_risk")
def q_page_by_risk(spark, d):
    from riskframe.functions.exprs import risk_band
    from riskframe.plans.q_features import LKEY, scored
    s = scored(spark, d).withColumn("risk_level", risk_band("PROBABILITY"))
    return round_double_cols(s.where(F.col("risk_level") == "HIGH").orderBy(
        F.col("PROBABILITY").desc(), *LKEY).offset(20).limit(50).select(*LKEY, "PROBABILITY", "risk_level"))


reg("page_by_risk", (
    "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, "
    f"{rnd_sql('l_quantity / 50e0')} AS PROBABILITY, 'HIGH' AS risk_level FROM lineitem WHERE l_quantity / 50e0 >= 0.5e0 "
    "ORDER BY l_quantity / 50e0 DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 50 OFFSET 20"))
