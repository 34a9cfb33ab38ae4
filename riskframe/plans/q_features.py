"""Row-level feature expressions bound to the application role."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskframe.functions import exprs as X
from riskframe.operators import features as FT
from riskframe.operators import loan
from riskframe.plans import sqlf as S
from riskframe.plans.bind import role, with_roles
from riskframe.plans.q_marts import CREDIT_ACTIVE_VOCAB, _bureau_final
from riskframe.plans.registry import query
from riskframe.plans.sqlgen import rnd_sql, round_double_cols

ORACLE: dict[str, str] = {}
K = "SK_ID_CURR"
APP = with_roles("application")
EMP = "NULLIF(DAYS_EMPLOYED, 365243)"
EMP_Y = S.clip_lower(f"-CAST({EMP} AS DOUBLE) / 365e0")
AGE = "(-CAST(DAYS_BIRTH AS DOUBLE) / 365e0)"
EXT = FT.EXT_SOURCES


def _app(spark, d):
    return role(spark, d, "application")


def _out(df, cols):
    return round_double_cols(df.select(K, *cols))


def reg(key, sql):
    ORACLE[key] = sql


# B1
@query("sentinel_null")
def q_sentinel(spark, d):
    return _out(FT.sentinel_null(_app(spark, d)), ["DAYS_EMPLOYED"])


reg("sentinel_null", APP + S.select([("DAYS_EMPLOYED", EMP, "i")], "application"))


# B2
@query("days_to_years")
def q_days_years(spark, d):
    df = FT.domain_features(_app(spark, d))
    return _out(df, ["AGE_YEARS", "EMPLOYMENT_YEARS", "IS_EMPLOYED"])


reg("days_to_years", APP + S.select([("AGE_YEARS", AGE, "d"), ("EMPLOYMENT_YEARS", EMP_Y, "d"),
                                     ("IS_EMPLOYED", S.flag(f"{EMP_Y} > 0"), "i")], "application"))


# B3
RATIOS = [("INCOME_PER_PERSON", "AMT_INCOME_TOTAL", "CNT_FAM_MEMBERS"),
          ("DEBT_TO_INCOME_RATIO", "AMT_CREDIT", "AMT_INCOME_TOTAL"),
          ("CREDIT_TO_GOODS_RATIO", "AMT_CREDIT", "AMT_GOODS_PRICE"),
          ("ANNUITY_TO_INCOME_RATIO", "AMT_ANNUITY", "AMT_INCOME_TOTAL"),
          ("CHILDREN_RATIO", "CNT_CHILDREN", "CNT_FAM_MEMBERS")]


@query("ratio_features")
def q_ratios(spark, d):
    df = FT.domain_features(_app(spark, d))
    return _out(df, [r[0] for r in RATIOS])


reg("ratio_features", APP + S.select([(n, S.div(a, b), "d") for n, a, b in RATIOS], "application"))


# B4
@query("flags")
def q_flags(spark, d):
    df = FT.credit_behaviour_features(FT.domain_features(_app(spark, d)))
    return _out(df, ["HAS_CHILDREN", "IS_EMPLOYED", "HIGH_PAYMENT_BURDEN", "IS_OVERFINANCED", "HIGH_LEVERAGE"])


reg("flags", APP + S.select([
    ("HAS_CHILDREN", S.flag("CNT_CHILDREN > 0"), "i"),
    ("IS_EMPLOYED", S.flag(f"{EMP_Y} > 0"), "i"),
    ("HIGH_PAYMENT_BURDEN", S.flag(f"{S.div('AMT_ANNUITY', 'AMT_INCOME_TOTAL')} > 0.4e0"), "i"),
    ("IS_OVERFINANCED", S.flag("AMT_CREDIT > AMT_GOODS_PRICE"), "i"),
    ("HIGH_LEVERAGE", S.flag(f"{S.div('AMT_CREDIT', 'AMT_INCOME_TOTAL')} > 10"), "i")], "application"))

DOCS = ["FLAG_DOCUMENT_2", "FLAG_DOCUMENT_3", "FLAG_DOCUMENT_4"]


# B5
@query("row_sum")
def q_row_sum(spark, d):
    return _out(FT.domain_features(_app(spark, d)), ["TOTAL_DOCUMENTS_PROVIDED"])


reg("row_sum", APP + S.select([("TOTAL_DOCUMENTS_PROVIDED", S.row_sum(DOCS), "d")], "application"))

ROWSTAT = ["mean", "std", "max", "min", "median", "range"]


# B6
@query("row_stats")
def q_row_stats(spark, d):
    df = FT.ext_source_features(_app(spark, d))
    return _out(df, [f"EXT_SOURCE_{s.upper()}" for s in ROWSTAT])


reg("row_stats", APP + S.select([(f"EXT_SOURCE_{s.upper()}", S.row_stat(EXT, s), "d") for s in ROWSTAT],
                                "application"))

WEIGHTED = "(0.1e0 * EXT_SOURCE_1 + 0.5e0 * EXT_SOURCE_2 + 0.4e0 * EXT_SOURCE_3)"


# B7
@query("weighted_blend")
def q_weighted(spark, d):
    return _out(FT.ext_source_features(_app(spark, d)), ["EXT_SOURCE_WEIGHTED"])


reg("weighted_blend", APP + S.select([("EXT_SOURCE_WEIGHTED", "(0e0 + " + WEIGHTED + ")", "d")], "application"))

POW = []
for _c in EXT:
    POW += [(f"{_c}_SQUARED", f"pow({_c}, 2)", "d"), (f"{_c}_CUBED", f"pow({_c}, 3)", "d"),
            (f"{_c}_SQRT", S.sqrt0(_c), "d")]
POW += [("AMT_CREDIT_LOG", S.log1p("AMT_CREDIT"), "d"), ("AMT_CREDIT_SQRT", S.sqrt("AMT_CREDIT"), "d"),
        ("INCOME_LOG", S.log1p("AMT_INCOME_TOTAL"), "d"), ("INCOME_SQRT", S.sqrt("AMT_INCOME_TOTAL"), "d"),
        ("AGE_LOG", S.log1p(AGE), "d"), ("AGE_SQUARED", f"pow({AGE}, 2)", "d")]


# B8
@query("powers_logs")
def q_powers(spark, d):
    df = FT.time_features(FT.credit_behaviour_features(FT.ext_source_features(_app(spark, d))))
    return _out(df, [p[0] for p in POW])


reg("powers_logs", APP + S.select(POW, "application"))

PAIRS = []
for _i, _a in enumerate(EXT):
    for _b in EXT[_i + 1:]:
        PAIRS += [(f"{_a}_x_{_b}", f"{_a} * {_b}", "d"), (f"{_a}_div_{_b}", S.div(_a, _b), "d"),
                  (f"{_a}_minus_{_b}", f"{_a} - {_b}", "d")]


# B9
@query("pairwise")
def q_pairwise(spark, d):
    return _out(FT.ext_source_features(_app(spark, d)), [p[0] for p in PAIRS])


reg("pairwise", APP + S.select(PAIRS, "application"))

INTER_SRC = {"AGE_YEARS": AGE, "EMPLOYMENT_YEARS": EMP_Y}
INTER = []
for _a, _b in FT.INTERACTIONS:
    ea, eb = INTER_SRC.get(_a, _a), INTER_SRC.get(_b, _b)
    INTER += [(f"{_a}_x_{_b}_INT", f"{ea} * {eb}", "d"), (f"{_a}_div_{_b}_INT", S.div(ea, eb), "d"),
              (f"{_a}_plus_{_b}_INT", f"{ea} + {eb}", "d")]


# B10
@query("interactions")
def q_interactions(spark, d):
    df = FT.interaction_features(FT.domain_features(_app(spark, d)))
    return _out(df, [p[0] for p in INTER])


reg("interactions", APP + S.select(INTER, "application"))


# B11
@query("interact_product")
def q_interact_product(spark, d):
    df = FT.product_interactions(_app(spark, d))
    return _out(df, [f"INTERACT_{a}_x_{b}" for a, b in FT.PRODUCT_INTERACTIONS])


reg("interact_product", APP + S.select(
    [(f"INTERACT_{a}_x_{b}", f"{a} * {b}", "i") if a.startswith("DAYS") and b.startswith("DAYS")
     else (f"INTERACT_{a}_x_{b}", f"CAST({a} AS DOUBLE) * {b}", "d") for a, b in FT.PRODUCT_INTERACTIONS],
    "application"))

POLY_COLS = ["AMT_INCOME_TOTAL", "AMT_GOODS_PRICE", "EXT_SOURCE_1", "OWN_CAR_AGE"]


# B12
@query("poly2")
def q_poly2(spark, d):
    app = _app(spark, d)
    df = FT.poly_features(app, POLY_COLS, 2)
    return _out(df, [c for c in df.columns if c.startswith("POLY_")])


def _poly_sql():
    import itertools
    med = ", ".join(f"MEDIAN(CAST({c} AS DOUBLE)) AS m_{c}" for c in POLY_COLS)
    filled = {c: f"COALESCE(CAST({c} AS DOUBLE), m.m_{c})" for c in POLY_COLS}
    pairs = []
    for combo in itertools.combinations_with_replacement(POLY_COLS, 2):
        a, b = combo
        name = f"{a}_pow_2" if a == b else f"{a}_x_{b}"
        pairs.append((f"POLY_{name}", f"{filled[a]} * {filled[b]}", "d"))
    return APP + S.select(pairs, f"application, (SELECT {med} FROM application) m")


reg("poly2", _poly_sql())

POLY_EXCLUDE = [K, "TARGET"]


# B13
@query("poly_pick")
def q_poly_pick(spark, d):
    """Priority features present, then top sample variance; all in Spark:
    one wide aggregate -> stack -> rank."""
    app = _app(spark, d)
    cand = FT.numeric_columns(app, POLY_EXCLUDE)
    wide = app.agg(*[F.var_samp(F.col(c).cast("double")).alias(c) for c in cand])
    stacked = wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("variance"), F.lit(i).alias("pos"))
        for i, c in enumerate(cand)])).alias("s")).select("s.*")
    prio = {c: i for i, c in enumerate(FT.POLY_PRIORITY)}
    pr = F.lit(None).cast("int")
    for c, i in prio.items():
        pr = F.when(F.col("feature") == c, F.lit(i)).otherwise(pr)
    w = Window.orderBy(F.col("prio").asc_nulls_last(), F.col("variance").desc_nulls_last(), F.col("pos"))
    # the window holds one row per column of the schema (bounded), not per data row
    return (stacked.withColumn("prio", pr)
            .withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= 15).select("rank", "feature"))


def _poly_pick_sql():
    import itertools  # noqa: F401
    from riskframe.plans.bind import _application
    cols = [n for n, _ in _application("duckdb") if n not in POLY_EXCLUDE and n not in
            ("NAME_CONTRACT_TYPE", "OCCUPATION_TYPE", "ORGANIZATION_TYPE", "CODE_GENDER")]
    union = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, VAR_SAMP(CAST({c} AS DOUBLE)) AS variance, {i} AS pos FROM application"
        for i, c in enumerate(cols))
    prio = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(FT.POLY_PRIORITY))
    return APP + (f"SELECT rank, feature FROM (SELECT feature, ROW_NUMBER() OVER (ORDER BY "
                  f"CASE feature {prio} END ASC NULLS LAST, variance DESC NULLS LAST, pos) AS rank "
                  f"FROM ({union}) u) r WHERE rank <= 15")


reg("poly_pick", _poly_pick_sql())


# B14
@query("bucketize")
def q_bucketize(spark, d):
    df = FT.credit_behaviour_features(FT.time_features(_app(spark, d)))
    return _out(df, ["AGE_GROUP", "INCOME_GROUP"])


reg("bucketize", APP + S.select([
    ("AGE_GROUP", S.bins(AGE, FT.AGE_BINS, FT.AGE_LABELS), "d"),
    ("INCOME_GROUP", S.bins("AMT_INCOME_TOTAL", FT.INCOME_BINS, FT.INCOME_LABELS), "d")], "application"))


# B15
@query("missing_indicators")
def q_missing(spark, d):
    df = FT.missing_value_features(_app(spark, d))
    return _out(df, [f"{c}_IS_MISSING" for c in FT.MISSING_IMPORTANT] + ["TOTAL_MISSING_COUNT", "MISSING_RATE"])


_MI = [(f"{c}_IS_MISSING", f"CAST(({c} IS NULL) AS BIGINT)", "i") for c in FT.MISSING_IMPORTANT]
_TOT = " + ".join(f"CAST(({c} IS NULL) AS BIGINT)" for c in FT.MISSING_IMPORTANT)
reg("missing_indicators", APP + S.select(
    _MI + [("TOTAL_MISSING_COUNT", f"({_TOT})", "i"), ("MISSING_RATE", f"({_TOT}) / 10e0", "d")], "application"))

CB = [("PAYMENT_BURDEN", S.div("AMT_ANNUITY", "AMT_INCOME_TOTAL"), "d"),
      ("PAYMENT_BURDEN_SQUARED", f"pow({S.div('AMT_ANNUITY', 'AMT_INCOME_TOTAL')}, 2)", "d"),
      ("HIGH_PAYMENT_BURDEN", S.flag(f"{S.div('AMT_ANNUITY', 'AMT_INCOME_TOTAL')} > 0.4e0"), "i"),
      ("AMT_CREDIT_LOG", S.log1p("AMT_CREDIT"), "d"), ("AMT_CREDIT_SQRT", S.sqrt("AMT_CREDIT"), "d"),
      ("CREDIT_TO_INCOME", S.div("AMT_CREDIT", "AMT_INCOME_TOTAL"), "d"),
      ("CREDIT_TO_INCOME_SQUARED", f"pow({S.div('AMT_CREDIT', 'AMT_INCOME_TOTAL')}, 2)", "d"),
      ("HIGH_LEVERAGE", S.flag(f"{S.div('AMT_CREDIT', 'AMT_INCOME_TOTAL')} > 10"), "i"),
      ("DOWN_PAYMENT", "AMT_GOODS_PRICE - AMT_CREDIT", "d"),
      ("DOWN_PAYMENT_RATE", S.clip(S.div("AMT_GOODS_PRICE - AMT_CREDIT", "AMT_GOODS_PRICE"), "-1e0", "1e0"), "d"),
      ("IS_OVERFINANCED", S.flag("AMT_CREDIT > AMT_GOODS_PRICE"), "i"),
      ("INCOME_LOG", S.log1p("AMT_INCOME_TOTAL"), "d"), ("INCOME_SQRT", S.sqrt("AMT_INCOME_TOTAL"), "d"),
      ("INCOME_PER_FAMILY_MEMBER", S.div("AMT_INCOME_TOTAL", "CNT_FAM_MEMBERS"), "d"),
      ("INCOME_GROUP", S.bins("AMT_INCOME_TOTAL", FT.INCOME_BINS, FT.INCOME_LABELS), "d")]


# B16
@query("credit_behaviour")
def q_credit_behaviour(spark, d):
    return _out(FT.credit_behaviour_features(_app(spark, d)), [c[0] for c in CB])


reg("credit_behaviour", APP + S.select(CB, "application"))

TF = [("AGE_YEARS", AGE, "d"), ("AGE_GROUP", S.bins(AGE, FT.AGE_BINS, FT.AGE_LABELS), "d"),
      ("AGE_SQUARED", f"pow({AGE}, 2)", "d"), ("AGE_LOG", S.log1p(AGE), "d"),
      ("DAYS_EMPLOYED", EMP, "i"), ("EMPLOYMENT_YEARS", EMP_Y, "d"),
      ("EMPLOYMENT_TO_AGE_RATIO", S.clip(S.div(EMP_Y, AGE), "0e0", "1e0"), "d")]
for _c in FT.TIME_COLS:
    TF += [(f"{_c}_YEARS", f"-CAST({_c} AS DOUBLE) / 365e0", "d"), (f"{_c}_IS_RECENT", S.flag(f"{_c} > -365"), "i")]
TF += [("CAR_AGE_SQUARED", "pow(OWN_CAR_AGE, 2)", "d"), ("HAS_OLD_CAR", S.flag("OWN_CAR_AGE > 10"), "i"),
       ("HAS_NEW_CAR", S.flag("OWN_CAR_AGE < 3"), "i")]


# B17
@query("time_features")
def q_time(spark, d):
    return _out(FT.time_features(_app(spark, d)), [c[0] for c in TF])


reg("time_features", APP + S.select(TF, "application"))


# B18
def _bureau_mart(spark, d):
    app = _app(spark, d).select(K, "AMT_INCOME_TOTAL")
    return app.join(loan.rollup_bureau(role(spark, d, "bureau"), CREDIT_ACTIVE_VOCAB), K, "left")


@query("agg_col_stats")
def q_agg_col_stats(spark, d):
    df = FT.aggregate_column_features(_bureau_mart(spark, d))
    return _out(df, ["BUREAU_TOTAL_DEBT", "BUREAU_DEBT_TO_INCOME", "BUREAU_CREDIT_MEAN", "BUREAU_CREDIT_STD",
                     "BUREAU_CREDIT_MAX", "BUREAU_AVG_CREDIT_AGE"])


def _agg_col_sql():
    from riskframe.plans.q_marts import B_D, B_O
    cols = [c for c in B_D + B_O if "BUREAU_" in c]
    # column order of the Spark rollup: spec stats, pivot counts, then ratios
    order = [f"BUREAU_{c}_{s.upper()}" for c, st in loan.BUREAU_SPEC.items() for s in st]
    order += [f"BUREAU_CREDIT_{v.upper()}_COUNT" for v in CREDIT_ACTIVE_VOCAB]
    order += ["BUREAU_DEBT_TO_CREDIT_RATIO", "BUREAU_OVERDUE_RATIO"]
    assert set(order) == set(cols)
    debt = [c for c in order if "DEBT" in c or "SUM" in c]
    credit = [c for c in order if "AMT_CREDIT" in c]
    days = [c for c in order if "DAYS_CREDIT" in c]
    pairs = [("BUREAU_TOTAL_DEBT", S.row_sum(debt), "d"),
             ("BUREAU_DEBT_TO_INCOME", S.div(S.row_sum(debt), "AMT_INCOME_TOTAL"), "d"),
             ("BUREAU_CREDIT_MEAN", S.row_stat(credit, "mean"), "d"),
             ("BUREAU_CREDIT_STD", S.row_stat(credit, "std"), "d"),
             ("BUREAU_CREDIT_MAX", S.row_stat(credit, "max"), "d"),
             ("BUREAU_AVG_CREDIT_AGE", f"{S.row_stat(days, 'mean')} / -365e0", "d")]
    src = (f"(SELECT a.SK_ID_CURR, a.AMT_INCOME_TOTAL, b.* EXCLUDE (SK_ID_CURR) FROM application a "
           f"LEFT JOIN ({_bureau_final()}) b ON a.SK_ID_CURR = b.SK_ID_CURR) m")
    return with_roles("application", "bureau") + S.select(pairs, src)


reg("agg_col_stats", _agg_col_sql())


# B19
@query("rating_mean")
def q_rating_mean(spark, d):
    return _out(FT.domain_features(_app(spark, d)), ["REGION_RATING_COMBINED"])


reg("rating_mean", APP + S.select(
    [("REGION_RATING_COMBINED", "(REGION_RATING_CLIENT + REGION_RATING_CLIENT_W_CITY) / 2e0", "d")], "application"))


# B20 (rows only: renaming is a schema operation)
@query("clean_names")
def q_clean_names(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    messy = li.select(F.col("l_orderkey").alias("order key"), F.col("l_quantity").alias("qty/unit"),
                      F.col("l_extendedprice").alias(" ext-price ($)"), F.col("l_tax").alias("tax__rate%"))
    return FT.clean_names(messy)


ORACLE["clean_names"] = 'SELECT l_orderkey AS order_key, l_quantity AS qty_unit, l_extendedprice AS "ext-price", l_tax AS tax_rate FROM lineitem'


DOMAIN = [("AGE_YEARS", AGE, "d"), ("DAYS_EMPLOYED", EMP, "i"), ("EMPLOYMENT_YEARS", EMP_Y, "d"),
          ("IS_EMPLOYED", S.flag(f"{EMP_Y} > 0"), "i")]
DOMAIN += [(n, S.div(a, b), "d") for n, a, b in RATIOS[:3]]
DOMAIN += [("CREDIT_UTILIZATION", S.div("AMT_CREDIT", "AMT_GOODS_PRICE"), "d"), (RATIOS[3][0], S.div(*RATIOS[3][1:]), "d"),
           ("HAS_CHILDREN", S.flag("CNT_CHILDREN > 0"), "i"), (RATIOS[4][0], S.div(*RATIOS[4][1:]), "d"),
           ("TOTAL_DOCUMENTS_PROVIDED", S.row_sum(DOCS), "d"),
           ("EXT_SOURCE_MEAN", S.row_stat(EXT, "mean"), "d"), ("EXT_SOURCE_MAX", S.row_stat(EXT, "max"), "d"),
           ("EXT_SOURCE_MIN", S.row_stat(EXT, "min"), "d"),
           ("REGION_RATING_COMBINED", "(REGION_RATING_CLIENT + REGION_RATING_CLIENT_W_CITY) / 2e0", "d")]


# B21
@query("domain_suite")
def q_domain_suite(spark, d):
    return _out(FT.domain_features(_app(spark, d)), [c[0] for c in DOMAIN])


reg("domain_suite", APP + S.select(DOMAIN, "application"))

ADV = ([p for p in PAIRS] + [(f"EXT_SOURCE_{s.upper()}", S.row_stat(EXT, s), "d") for s in ROWSTAT]
       + [("EXT_SOURCE_WEIGHTED", "(0e0 + " + WEIGHTED + ")", "d")]
       + [p for p in POW if p[0].startswith("EXT_SOURCE")]
       + _MI + [("TOTAL_MISSING_COUNT", f"({_TOT})", "i"), ("MISSING_RATE", f"({_TOT}) / 10e0", "d")]
       + TF + [c for c in CB] + INTER)


@query("advanced_suite")
def q_advanced_suite(spark, d):
    df = FT.advanced_features(_app(spark, d))
    names = []
    for n, _, _ in ADV:
        if n not in names:
            names.append(n)
    return _out(df, names)


def _adv_sql():
    seen, pairs = set(), []
    for p in ADV:
        if p[0] not in seen:
            seen.add(p[0])
            pairs.append(p)
    return APP + S.select(pairs, "application")


reg("advanced_suite", _adv_sql())

# ---------------------------------------------------------------- scored tables


def scored(spark, d):
    """Scored-table role over lineitem: TARGET = returned, PROBABILITY = qty / 50."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                     F.when(F.col("l_returnflag") == "R", 1).otherwise(0).cast("bigint").alias("TARGET"),
                     (F.col("l_quantity") / F.lit(50.0)).alias("PROBABILITY"),
                     (F.col("l_extendedprice") / F.lit(105000.0)).alias("PROBABILITY2"))


SCORED_SQL = ("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, "
              "CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS BIGINT) AS TARGET, "
              "l_quantity / 50e0 AS PROBABILITY, l_extendedprice / 105000e0 AS PROBABILITY2 FROM lineitem")
SCORED_WITH = f"WITH scored AS ({SCORED_SQL})\n"
LKEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


# B22
@query("risk_band")
def q_risk_band(spark, d):
    return scored(spark, d).select(*LKEY, X.risk_band("PROBABILITY").alias("risk_level"))


RISK_SQL = ("CASE WHEN {p} < 0.3e0 THEN 'LOW' WHEN {p} < 0.5e0 THEN 'MEDIUM' "
            "WHEN {p} IS NOT NULL THEN 'HIGH' END")
reg("risk_band", SCORED_WITH + f"SELECT {', '.join(LKEY)}, {RISK_SQL.format(p='PROBABILITY')} AS risk_level FROM scored")


# B23
@query("decision")
def q_decision(spark, d):
    s = scored(spark, d).withColumn("prediction", F.when(F.col("PROBABILITY") >= 0.5, 1).otherwise(0))
    return s.select(*LKEY, F.col("prediction").cast("bigint").alias("prediction"),
                    F.when(F.col("prediction") == 1, "Default").otherwise("No Default").alias("decision"))


reg("decision", SCORED_WITH + (
    f"SELECT {', '.join(LKEY)}, CAST(CASE WHEN PROBABILITY >= 0.5e0 THEN 1 ELSE 0 END AS BIGINT) AS prediction, "
    "CASE WHEN PROBABILITY >= 0.5e0 THEN 'Default' ELSE 'No Default' END AS decision FROM scored"))


# B24
@query("quantile_band")
def q_quantile_band(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    # one-row quantile table: a broadcast of bounded (1-row) size
    from riskframe.operators.ordered import exact_quantiles
    q = exact_quantiles(c, "c_acctbal", [0.9, 0.1]).agg(
        F.max(F.when(F.col("p_index") == 0, F.col("quantile"))).alias("p90"),
        F.max(F.when(F.col("p_index") == 1, F.col("quantile"))).alias("p10"))
    out = c.crossJoin(F.broadcast(q)).select(
        "c_custkey", F.when(F.col("c_acctbal") >= F.col("p90"), "High")
        .when(F.col("c_acctbal") <= F.col("p10"), "Low").otherwise("Medium").alias("risk_category"))
    return out


reg("quantile_band", (
    "SELECT c_custkey, CASE WHEN c_acctbal >= p90 THEN 'High' WHEN c_acctbal <= p10 THEN 'Low' ELSE 'Medium' END "
    "AS risk_category FROM customer, (SELECT quantile_cont(c_acctbal::DOUBLE, 0.9) AS p90, "
    "quantile_cont(c_acctbal::DOUBLE, 0.1) AS p10 FROM customer) q"))

# fixed values: pseudonymisation salt, space and offset
PSEUDO_SALT = "_salt_2024"


# B25
@query("pseudonymize")
def q_pseudonymize(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    return c.select("c_custkey", X.pseudonym("c_custkey", PSEUDO_SALT).alias("pseudo_id"))


reg("pseudonymize", (
    f"SELECT c_custkey, (CAST('0x' || substr(sha256(CAST(c_custkey AS VARCHAR) || '{PSEUDO_SALT}'), 1, 8) AS BIGINT)"
    " % 900000) + 100000 AS pseudo_id FROM customer"))


# B27
@query("per_item")
def q_per_item(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet")
    g = ev.groupBy("user_id").agg(F.sum("value").alias("total_ms"),
                                  F.count_if(F.col("event_type") == "purchase").alias("n_items"))
    return round_double_cols(g.withColumn("ms_per_item", F.coalesce(F.try_divide("total_ms", "n_items"), F.lit(0.0))))


reg("per_item", (
    f"SELECT user_id, {rnd_sql('SUM(value)')} AS total_ms, CAST(COUNT_IF(event_type = 'purchase') AS BIGINT) AS n_items, "
    f"{rnd_sql('COALESCE(SUM(value) / NULLIF(COUNT_IF(event_type = ' + chr(39) + 'purchase' + chr(39) + '), 0), 0e0)')} AS ms_per_item "
    "FROM events GROUP BY user_id"))


@query("feature_strategies")
def q_feature_strategies(spark, d):
    """Width of the model table under each feature strategy."""
    app = _app(spark, d)
    num = [c for c in FT.numeric_columns(app, ["SK_ID_CURR", "TARGET"])]
    rows = None
    for name in FT.FEATURE_STRATEGIES:
        df = FT.feature_strategy(app.select("SK_ID_CURR", "TARGET", *num), name, POLY_COLS[:3])
        r = df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("strategy"), F.lit(len(df.columns) - 2).cast("bigint").alias("n_features"), "n_rows")
        rows = r if rows is None else rows.unionByName(r)
    return rows
