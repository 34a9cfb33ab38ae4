"""Summaries (E), rankings and windows (F) bound to the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskframe.operators import profile as P
from riskframe.operators.ordered import running_sum
from riskframe.plans.bind import role, with_roles
from riskframe.plans.q_features import LKEY, SCORED_SQL, scored
from riskframe.plans.registry import query
from riskframe.plans.sqlgen import rnd_sql, round_double_cols

ORACLE: dict[str, str] = {}
LI_SEL = "l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey"


def reg(k, s):
    ORACLE[k] = s


def T(spark, d, t):
    return spark.read.parquet(f"{d}/{t}.parquet")


def plog(spark, d):
    return P.prediction_log(T(spark, d, "events"))


PROB = "LEAST(value / 500e0, 1e0)"
BAND = f"CASE WHEN {PROB} < 0.3e0 THEN 'LOW' WHEN {PROB} < 0.5e0 THEN 'MEDIUM' ELSE 'HIGH' END"
LOG = (f"WITH log AS (SELECT *, CAST(ts AS DATE) AS batch_date, {PROB} AS probability, {BAND} AS risk_level FROM events)")
BATCH = (", b AS (SELECT batch_date, COUNT(*) AS total, COUNT_IF(event_type = 'error') AS n_errors, "
         "(epoch_us(MAX(ts)) - epoch_us(MIN(ts))) / 1e6 AS pts, AVG(probability) AS avg_probability, "
         "COUNT_IF(risk_level = 'LOW') AS n_low, COUNT_IF(risk_level = 'MEDIUM') AS n_medium, COUNT_IF(risk_level = 'HIGH') AS n_high, "
         "CASE WHEN COUNT_IF(event_type = 'error') / COUNT(*) > 0.22e0 THEN 'failed' ELSE 'completed' END AS status FROM log GROUP BY batch_date)")


@query("class_balance")
def q_class_balance(spark, d):
    return round_double_cols(P.class_balance(scored(spark, d), "TARGET"))


reg("class_balance", f"SELECT TARGET, COUNT(*) AS count, {rnd_sql('COUNT(*) / SUM(COUNT(*)) OVER ()')} AS share, "
    f"{rnd_sql('MAX(COUNT(*)) OVER () / MIN(COUNT(*)) OVER ()')} AS imbalance_ratio FROM ({SCORED_SQL}) s GROUP BY TARGET")


@query("crosstab_pct")
def q_crosstab(spark, d):
    a = role(spark, d, "application")
    return round_double_cols(P.crosstab_pct(a, "NAME_CONTRACT_TYPE", "TARGET"))


reg("crosstab_pct", with_roles("application") + (
    f"SELECT NAME_CONTRACT_TYPE, TARGET, COUNT(*) AS count, {rnd_sql('COUNT(*) * 100e0 / SUM(COUNT(*)) OVER (PARTITION BY NAME_CONTRACT_TYPE)')} "
    "AS row_pct FROM application GROUP BY NAME_CONTRACT_TYPE, TARGET"))


@query("describe_by")
def q_describe(spark, d):
    return round_double_cols(P.describe_by(T(spark, d, "customer"), ["c_mktsegment"], "c_acctbal"))


reg("describe_by", "SELECT c_mktsegment, COUNT(c_acctbal) AS count, " + ", ".join(
    f"{rnd_sql(e)} AS {n}" for n, e in [("mean", "AVG(c_acctbal)"), ("std", "STDDEV_SAMP(c_acctbal)"), ("min", "MIN(c_acctbal)"),
                                        ("p25", "quantile_cont(c_acctbal::DOUBLE, 0.25)"), ("p50", "quantile_cont(c_acctbal::DOUBLE, 0.5)"),
                                        ("p75", "quantile_cont(c_acctbal::DOUBLE, 0.75)"), ("max", "MAX(c_acctbal)")])
    + " FROM customer GROUP BY c_mktsegment")

CATS = ["NAME_CONTRACT_TYPE", "OCCUPATION_TYPE", "ORGANIZATION_TYPE", "CODE_GENDER"]


@query("category_profile")
def q_category_profile(spark, d):
    return P.category_profile(role(spark, d, "application"), CATS)


reg("category_profile", with_roles("application") + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, COUNT(*) AS n_unique, arg_max(v, n * 1000000 - rk) AS mode, MAX(n) AS mode_freq FROM "
    f"(SELECT {c} AS v, COUNT(*) AS n, ROW_NUMBER() OVER (ORDER BY {c}) AS rk FROM application WHERE {c} IS NOT NULL GROUP BY {c}) g"
    for c in CATS))

CORR_COLS = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "EXT_SOURCE_1", "EXT_SOURCE_2", "DAYS_BIRTH", "CNT_CHILDREN"]


def corr_sql(a, b, src="application"):
    both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
    x, y = f"CASE WHEN {both} THEN CAST({a} AS DOUBLE) END", f"CASE WHEN {both} THEN CAST({b} AS DOUBLE) END"
    return f"COVAR_POP({x}, {y}) / NULLIF(STDDEV_POP({x}) * STDDEV_POP({y}), 0)"


@query("corr_target")
def q_corr_target(spark, d):
    return round_double_cols(P.corr_target(role(spark, d, "application"), CORR_COLS, "TARGET"))


reg("corr_target", with_roles("application") + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {rnd_sql(corr_sql(c, 'TARGET'))} AS corr, {rnd_sql('abs(' + corr_sql(c, 'TARGET') + ')')} AS abs_corr FROM application"
    for c in CORR_COLS))


@query("corr_matrix")
def q_corr_matrix(spark, d):
    return round_double_cols(P.corr_matrix(role(spark, d, "application"), CORR_COLS))


reg("corr_matrix", with_roles("application") + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {rnd_sql(corr_sql(a, b))} AS corr FROM application"
    for i, a in enumerate(CORR_COLS) for b in CORR_COLS[i + 1:]))


@query("risk_distribution")
def q_risk_distribution(spark, d):
    return round_double_cols(plog(spark, d).groupBy("risk_level").agg(
        F.count(F.lit(1)).alias("count"), F.avg("probability").alias("avg_probability")))


reg("risk_distribution", LOG + f" SELECT risk_level, COUNT(*) AS count, {rnd_sql('AVG(probability)')} AS avg_probability FROM log GROUP BY risk_level")


@query("daily_counts")
def q_daily_counts(spark, d, days: int = 7):
    lg = plog(spark, d)
    return P.after_newest(lg, "batch_date", lambda mx: F.date_sub(mx, days)).groupBy("batch_date").agg(
        F.count(F.lit(1)).alias("count")).orderBy(F.col("batch_date").desc()).withColumn(
        "batch_date", F.col("batch_date").cast("string"))


reg("daily_counts", LOG + " SELECT CAST(batch_date AS VARCHAR) AS batch_date, COUNT(*) AS count FROM log WHERE batch_date > (SELECT MAX(batch_date) FROM log) - INTERVAL 7 DAY "
    "GROUP BY batch_date ORDER BY batch_date DESC")


@query("avg_processing")
def q_avg_processing(spark, d):
    b = P.batches(plog(spark, d))
    return round_double_cols(b.where(F.col("status") == "completed").agg(
        F.avg("processing_time_seconds").alias("avg_processing_seconds"), F.count(F.lit(1)).alias("n_completed")))


reg("avg_processing", LOG + BATCH + f" SELECT {rnd_sql('AVG(pts)')} AS avg_processing_seconds, COUNT(*) AS n_completed FROM b WHERE status = 'completed'")


@query("batch_stats")
def q_batch_stats(spark, d):
    b = P.batches(plog(spark, d))
    return round_double_cols(b.agg(
        F.count(F.lit(1)).alias("n_batches"), F.sum("total").alias("n_predictions"),
        F.count_if(F.col("status") == "failed").alias("n_failed"),
        (F.sum(F.col("avg_probability") * F.col("total")) / F.sum("total")).alias("avg_probability"),
        F.sum("n_low").alias("n_low"), F.sum("n_medium").alias("n_medium"), F.sum("n_high").alias("n_high")))


reg("batch_stats", LOG + BATCH + (
    f" SELECT COUNT(*) AS n_batches, CAST(SUM(total) AS BIGINT) AS n_predictions, CAST(COUNT_IF(status = 'failed') AS BIGINT) AS n_failed, "
    f"{rnd_sql('SUM(avg_probability * total) / SUM(total)')} AS avg_probability, CAST(SUM(n_low) AS BIGINT) AS n_low, "
    "CAST(SUM(n_medium) AS BIGINT) AS n_medium, CAST(SUM(n_high) AS BIGINT) AS n_high FROM b"))


@query("log_summary")
def q_log_summary(spark, d):
    lg = plog(spark, d)
    pred = F.col("event_type") == "purchase"
    return round_double_cols(lg.agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if(pred).alias("n_predictions"),
        F.count_if(F.col("event_type") == "error").alias("n_errors"),
        F.avg("value").alias("mean_latency_ms"),
        F.try_divide(F.sum("value"), F.count_if(pred)).alias("ms_per_prediction"),
        (F.avg((F.col("risk_level") == "HIGH").cast("double")) * 100).alias("high_risk_pct"),
        F.min("probability").alias("min_probability"), F.max("probability").alias("max_probability"),
        F.avg("probability").alias("avg_probability")))


reg("log_summary", LOG + (
    " SELECT COUNT(*) AS n_events, CAST(COUNT_IF(event_type = 'purchase') AS BIGINT) AS n_predictions, "
    "CAST(COUNT_IF(event_type = 'error') AS BIGINT) AS n_errors, " + ", ".join(f"{rnd_sql(e)} AS {n}" for n, e in [
        ("mean_latency_ms", "AVG(value)"), ("ms_per_prediction", "SUM(value) / NULLIF(COUNT_IF(event_type = 'purchase'), 0)"),
        ("high_risk_pct", "AVG(CAST(risk_level = 'HIGH' AS DOUBLE)) * 100"), ("min_probability", "MIN(probability)"),
        ("max_probability", "MAX(probability)"), ("avg_probability", "AVG(probability)")]) + " FROM log"))


@query("error_top5")
def q_error_top5(spark, d):
    lg = plog(spark, d).where(F.col("event_type") == "error")
    msg = F.concat(F.lit("code_"), (F.get_json_object("props", "$.k").cast("int") % 7).cast("string"))
    return lg.groupBy(msg.alias("message")).agg(F.count(F.lit(1)).alias("count")).orderBy(
        F.col("count").desc(), "message").limit(5)


reg("error_top5", "SELECT 'code_' || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 7 AS VARCHAR) AS message, COUNT(*) AS count "
    "FROM events WHERE event_type = 'error' GROUP BY 1 ORDER BY count DESC, message LIMIT 5")


@query("rolling_rates")
def q_rolling(spark, d):
    return round_double_cols(P.rolling_rates(plog(spark, d), 7))


reg("rolling_rates", LOG + (
    " SELECT COUNT(*) AS n, " + ", ".join(f"{rnd_sql(e)} AS {n}" for n, e in [
        ("default_rate", "AVG(CAST(event_type = 'error' AS DOUBLE))"), ("avg_probability", "AVG(probability)"),
        ("high_risk_pct", "AVG(CAST(risk_level = 'HIGH' AS DOUBLE)) * 100e0")])
    + " FROM log WHERE ts > (SELECT MAX(ts) FROM log) - INTERVAL 7 DAY"))


def experiments(spark, d):
    """Experiment-result role over part: config = (p_type, p_brand), metric = retail price / 2100."""
    return T(spark, d, "part").select(F.col("p_type").alias("feature_strategy"), F.col("p_brand").alias("sampling_strategy"),
                                      F.col("p_size").alias("param"), (F.col("p_retailprice") / F.lit(2100.0)).alias("score"),
                                      (F.col("p_size") / F.lit(50.0)).alias("train_score"))


EXP = ("WITH e AS (SELECT p_type AS feature_strategy, p_brand AS sampling_strategy, CAST(p_size AS BIGINT) AS param, "
       "p_retailprice / 2100e0 AS score, p_size / 50e0 AS train_score FROM part)")


@query("experiment_summary")
def q_experiment_summary(spark, d):
    e = experiments(spark, d)
    return round_double_cols(e.groupBy("feature_strategy", "sampling_strategy").agg(
        F.avg("score").alias("score_mean"), F.stddev_samp("score").alias("score_std"), F.count(F.lit(1)).alias("n_folds")))


reg("experiment_summary", EXP + f" SELECT feature_strategy, sampling_strategy, {rnd_sql('AVG(score)')} AS score_mean, "
    f"{rnd_sql('STDDEV_SAMP(score)')} AS score_std, COUNT(*) AS n_folds FROM e GROUP BY ALL")


@query("param_effect")
def q_param_effect(spark, d):
    return round_double_cols(experiments(spark, d).groupBy("param").agg(F.avg("score").alias("mean_score")))


reg("param_effect", EXP + f" SELECT param, {rnd_sql('AVG(score)')} AS mean_score FROM e GROUP BY param")


@query("leaderboard")
def q_leaderboard(spark, d):
    s = experiments(spark, d).groupBy("feature_strategy", "sampling_strategy").agg(F.avg("score").alias("score_mean"))
    # one row per configuration: the ranking window is over configs, not data rows
    w = Window.orderBy(F.col("score_mean").desc(), "feature_strategy", "sampling_strategy")
    return round_double_cols(s.withColumn("rank", F.row_number().over(w)).withColumn("is_best", F.col("rank") == 1))


reg("leaderboard", EXP + f" SELECT feature_strategy, sampling_strategy, {rnd_sql('score_mean')} AS score_mean, rank, rank = 1 AS is_best FROM ("
    "SELECT *, ROW_NUMBER() OVER (ORDER BY score_mean DESC, feature_strategy, sampling_strategy) AS rank FROM ("
    "SELECT feature_strategy, sampling_strategy, AVG(score) AS score_mean FROM e GROUP BY ALL) a) r")


@query("fit_status")
def q_fit_status(spark, d):
    e = experiments(spark, d)
    st = F.when(F.col("train_score") - F.col("score") > 0.05, "overfitting").when(F.col("score") < 0.70, "underfitting").otherwise("good")
    return e.groupBy(st.alias("status")).agg(F.count(F.lit(1)).alias("n_runs"))


reg("fit_status", EXP + " SELECT CASE WHEN train_score - score > 0.05e0 THEN 'overfitting' WHEN score < 0.70e0 THEN 'underfitting' "
    "ELSE 'good' END AS status, COUNT(*) AS n_runs FROM e GROUP BY 1")


def imp(spark, d):
    return P.importance_table(T(spark, d, "part"), "p_name", "p_size")


IMP = "WITH imp AS (SELECT p_name AS feature, CAST(SUM(p_size) AS DOUBLE) AS importance FROM part GROUP BY p_name)"


@query("cum_importance")
def q_cum_importance(spark, d):
    return round_double_cols(P.ranked_importance(imp(spark, d)))


reg("cum_importance", IMP + f" SELECT feature, {rnd_sql('importance')} AS importance, ROW_NUMBER() OVER w AS rank, "
    f"{rnd_sql('SUM(importance) OVER (w ROWS UNBOUNDED PRECEDING) / SUM(importance) OVER ()')} AS cumulative_importance "
    "FROM imp WINDOW w AS (ORDER BY importance DESC, feature)")


@query("critical_features")
def q_critical(spark, d):
    return round_double_cols(P.critical_features(imp(spark, d), 0.85, 50, True))


reg("critical_features", IMP + (
    f", r AS (SELECT feature, importance, ROW_NUMBER() OVER w AS rank, SUM(importance) OVER (w ROWS UNBOUNDED PRECEDING) / SUM(importance) OVER () AS cum "
    "FROM imp WINDOW w AS (ORDER BY importance DESC, feature)) "
    f"SELECT feature, {rnd_sql('importance')} AS importance, rank, {rnd_sql('cum')} AS cumulative_importance FROM r "
    "WHERE rank <= GREATEST((SELECT COUNT_IF(cum <= 0.85e0) FROM r), LEAST(50, (SELECT COUNT(*) FROM r)))"))


@query("raw_importance")
def q_raw_importance(spark, d):
    return round_double_cols(P.raw_importance(imp(spark, d), F.split(F.col("feature"), " ")))


reg("raw_importance", IMP + (
    f" SELECT raw_feature, {rnd_sql('SUM(importance)')} AS importance, COUNT(*) AS n_derived, "
    "list_slice(list(feature ORDER BY importance DESC, feature), 1, 5) AS top_contributors FROM ("
    "SELECT feature, importance, UNNEST(list_distinct(string_split(feature, ' '))) AS raw_feature FROM imp) e GROUP BY raw_feature"))


@query("max_prob_shift")
def q_max_prob_shift(spark, d):
    b = P.batches(plog(spark, d))
    # one row per batch: the window spans batches, not predictions
    w = Window.orderBy("batch_date")
    s = b.withColumn("shift", F.coalesce(F.abs(F.col("avg_probability") - F.lag("avg_probability").over(w)), F.lit(0.0)))
    return round_double_cols(s.agg(F.max("shift").alias("max_shift"), F.count(F.lit(1)).alias("n_batches")))


reg("max_prob_shift", LOG + BATCH + f" SELECT {rnd_sql('MAX(sh)')} AS max_shift, COUNT(*) AS n_batches FROM ("
    "SELECT COALESCE(abs(avg_probability - LAG(avg_probability) OVER (ORDER BY batch_date)), 0e0) AS sh FROM b) x")


@query("wow_cost")
def q_wow_cost(spark, d):
    lg = plog(spark, d)
    wk = lg.groupBy(F.date_trunc("week", "ts").alias("week")).agg(
        (F.lit(10.0) * F.count_if(F.col("event_type") == "error") + F.count_if(F.col("event_type") == "view")).alias("cost"))
    w = Window.orderBy("week")  # one row per week
    prev = F.lag("cost").over(w)
    inc = F.try_divide((F.col("cost") - prev) * F.lit(100.0), prev)
    return round_double_cols(wk.select(F.to_date("week").cast("string").alias("week"), "cost", inc.alias("pct_increase"),
                                       F.coalesce(inc > 20, F.lit(False)).alias("alert")))


reg("wow_cost", LOG + (
    ", wk AS (SELECT date_trunc('week', ts) AS week, 10e0 * COUNT_IF(event_type = 'error') + COUNT_IF(event_type = 'view') AS cost FROM log GROUP BY 1) "
    f"SELECT CAST(CAST(week AS DATE) AS VARCHAR) AS week, {rnd_sql('cost')} AS cost, {rnd_sql('(cost - LAG(cost) OVER (ORDER BY week)) * 100e0 / NULLIF(LAG(cost) OVER (ORDER BY week), 0)')} AS pct_increase, "
    "COALESCE((cost - LAG(cost) OVER (ORDER BY week)) * 100e0 / NULLIF(LAG(cost) OVER (ORDER BY week), 0) > 20, false) AS alert FROM wk"))


@query("topk")
def q_topk(spark, d):
    return round_double_cols(scored(spark, d).orderBy(F.col("PROBABILITY2").desc(), *LKEY).limit(10).select(*LKEY, "PROBABILITY2"))


reg("topk", f"SELECT {LI_SEL}, {rnd_sql('l_extendedprice / 105000e0')} AS PROBABILITY2 FROM lineitem "
    "ORDER BY l_extendedprice / 105000e0 DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 10")


@query("top_mid_bottom")
def q_top_mid_bottom(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_totalprice").withColumn("one", F.lit(1))
    r = running_sum(o, "o_orderkey", ["one"])   # exact ascending rank without a global window
    n = o.agg(F.count(F.lit(1)).alias("__n"))
    j = r.crossJoin(n).withColumn("pos", F.col("cum_one") - 1)
    sel = (F.when(F.col("pos") >= F.col("__n") - 3, "top").when(F.col("pos") < 4, "bottom")
           .when(F.abs(F.col("pos") - F.floor(F.col("__n") / 2)) <= 1, "middle"))
    return round_double_cols(j.withColumn("part", sel).where(F.col("part").isNotNull()).select("o_orderkey", "o_totalprice", "part"))


reg("top_mid_bottom", (
    "WITH r AS (SELECT o_orderkey, o_totalprice, ROW_NUMBER() OVER (ORDER BY o_orderkey) - 1 AS pos, COUNT(*) OVER () AS n FROM orders) "
    f"SELECT o_orderkey, {rnd_sql('o_totalprice')} AS o_totalprice, CASE WHEN pos >= n - 3 THEN 'top' WHEN pos < 4 THEN 'bottom' ELSE 'middle' END AS part "
    "FROM r WHERE pos >= n - 3 OR pos < 4 OR abs(pos - n // 2) <= 1"))


@query("representatives")
def q_representatives(spark, d):
    s = scored(spark, d).select(*LKEY, "PROBABILITY2")
    hi = s.orderBy(F.col("PROBABILITY2").desc(), *LKEY).limit(2).withColumn("kind", F.lit("highest"))
    lo = s.orderBy(F.col("PROBABILITY2").asc(), *LKEY).limit(2).withColumn("kind", F.lit("lowest"))
    near = s.orderBy(F.abs(F.col("PROBABILITY2") - F.lit(0.3282)), *LKEY).limit(1).withColumn("kind", F.lit("near_threshold"))
    return round_double_cols(hi.unionByName(lo).unionByName(near))


reg("representatives", " UNION ALL ".join(
    f"(SELECT {LI_SEL}, {rnd_sql('l_extendedprice / 105000e0')} AS PROBABILITY2, '{k}' AS kind FROM lineitem ORDER BY {o}, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT {n})"
    for k, o, n in [("highest", "l_extendedprice / 105000e0 DESC", 2), ("lowest", "l_extendedprice / 105000e0 ASC", 2),
                    ("near_threshold", "abs(l_extendedprice / 105000e0 - 0.3282e0)", 1)]))

# contribution role: linear weights on scaled lineitem columns
CONTRIB = [("l_quantity", "l_quantity / 50e0", 0.8), ("l_extendedprice", "l_extendedprice / 105000e0", 1.5),
           ("l_discount", "l_discount * 10e0", -0.6), ("l_tax", "l_tax * 10e0", 0.4)]


def contributions(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return li.select(*LKEY, F.array(*[F.struct(F.lit(n).alias("feature"), F.expr(e).alias("value"),
                                               (F.expr(e) * F.lit(w)).alias("contribution")) for n, e, w in CONTRIB]).alias("contribs"))


@query("topk_per_row")
def q_topk_per_row(spark, d):
    c = contributions(spark, d)
    keyed = F.transform("contribs", lambda s: F.struct(F.abs(s["contribution"]).alias("abs_c"), s["feature"].alias("feature"),
                                                        s["contribution"].alias("contribution")))
    top = F.slice(F.sort_array(keyed, asc=False), 1, 2)
    return c.select(*LKEY, F.transform(top, lambda s: s["feature"]).alias("top_features"),
                    F.transform(top, lambda s: F.round(s["contribution"], 6)).alias("top_contributions"))


def _topk_row_sql():
    structs = ", ".join(f"{{'abs_c': abs(({e}) * {w}), 'feature': '{n}', 'contribution': ({e}) * {w}}}" for n, e, w in CONTRIB)
    return (f"SELECT {LI_SEL}, list_transform(t, lambda s: s.feature) AS top_features, "
            f"list_transform(t, lambda s: round(s.contribution, 6)) AS top_contributions FROM ("
            f"SELECT *, list_slice(list_reverse_sort([{structs}]), 1, 2) AS t FROM lineitem) x")


reg("topk_per_row", _topk_row_sql())


@query("waterfall_steps")
def q_waterfall(spark, d):
    """Row-local: the two largest contributions and the sum of the others, in
    order of size, as running steps from the base value (no exchange)."""
    base = 0.1
    c = contributions(spark, d)
    ranked = F.sort_array(F.transform("contribs", lambda s: F.struct((-F.abs(s["contribution"])).alias("o"), s["feature"].alias("feature"),
                                                                     s["contribution"].alias("contribution"))))
    rest = F.aggregate(F.slice("r", 3, len(CONTRIB)), F.lit(0.0), lambda a, s: a + s["contribution"])
    step = F.array_append(F.transform(F.slice("r", 1, 2), lambda s: F.struct(F.abs(s["contribution"]).alias("o"), s["feature"].alias("feature"),
                                                                             s["contribution"].alias("contribution"))),
                          F.struct(F.abs("rest").alias("o"), F.lit("sum of other features").alias("feature"), F.col("rest").alias("contribution")))
    x = c.select(*LKEY, ranked.alias("r")).withColumn("rest", rest).select(*LKEY, F.sort_array(step).alias("s"))
    end = F.transform("s", lambda s, i: F.struct(s["feature"].alias("feature"), s["contribution"].alias("contribution"), F.aggregate(
        F.slice("s", 1, i + 1), F.lit(base), lambda a, t: a + t["contribution"]).alias("end_value")))
    out = x.select(*LKEY, F.inline(end)).withColumn("start_value", F.col("end_value") - F.col("contribution"))
    return round_double_cols(out)


def _waterfall_sql():
    keys = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
    long = " UNION ALL ".join(f"SELECT rid, {LI_SEL}, '{n}' AS feature, ({e}) * {w} AS contribution FROM li" for n, e, w in CONTRIB)
    run = "SUM(contribution) OVER (PARTITION BY rid ORDER BY abs(contribution), feature ROWS UNBOUNDED PRECEDING)"
    return (f"WITH li AS (SELECT *, ROW_NUMBER() OVER () AS rid FROM lineitem), l AS ({long}), "
            "r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY rid ORDER BY abs(contribution) DESC, feature) AS rk FROM l), "
            f"st AS (SELECT rid, {keys}, CASE WHEN rk <= 2 THEN feature ELSE 'sum of other features' END AS feature, SUM(contribution ORDER BY rk) AS contribution "
            f"FROM r GROUP BY ALL) SELECT {keys}, feature, {rnd_sql('contribution')} AS contribution, "
            f"{rnd_sql(f'0.1e0 + {run}')} AS end_value, {rnd_sql(f'0.1e0 + {run} - contribution')} AS start_value FROM st")


reg("waterfall_steps", _waterfall_sql())


@query("drift_history")
def q_drift_history(spark, d):
    lg = plog(spark, d)
    overall = lg.agg(F.avg("value").alias("__m"))
    daily = lg.groupBy("batch_date").agg(F.avg("value").alias("mean_value")).crossJoin(overall)
    return round_double_cols(daily.select(F.lit("value").alias("feature"), F.col("batch_date").cast("string").alias("batch_date"),
                                          F.abs(F.col("mean_value") / F.col("__m") - 1).alias("drift_score"))
                             .orderBy(F.col("batch_date").desc()).limit(10))


reg("drift_history", LOG + f" SELECT 'value' AS feature, CAST(batch_date AS VARCHAR) AS batch_date, {rnd_sql('abs(AVG(value) / (SELECT AVG(value) FROM log) - 1)')} AS drift_score "
    "FROM log GROUP BY batch_date ORDER BY batch_date DESC LIMIT 10")


@query("recent_page")
def q_recent_page(spark, d):
    return round_double_cols(T(spark, d, "events").orderBy(F.col("ts").desc(), F.col("event_id").desc())
                             .offset(20).limit(25).select("event_id", "ts", "event_type", "value"))


reg("recent_page", f"SELECT event_id, ts, event_type, {rnd_sql('value')} AS value FROM events ORDER BY ts DESC, event_id DESC LIMIT 25 OFFSET 20")


@query("diff_bands")
def q_diff_bands(spark, d):
    s = scored(spark, d)
    dd = F.abs(F.col("PROBABILITY") - F.col("PROBABILITY2"))
    return round_double_cols(s.agg(
        F.count(F.lit(1)).alias("n"), F.avg(dd).alias("mean_abs_diff"), F.max(dd).alias("max_abs_diff"),
        F.count_if(dd < 1e-4).alias("n_lt_1e4"), F.count_if(dd < 0.01).alias("n_lt_01"), F.count_if(dd < 0.05).alias("n_lt_05"),
        F.count_if(dd < 0.10).alias("n_lt_10"), F.count_if(dd >= 0.10).alias("n_ge_10")))


_DD = "abs(l_quantity / 50e0 - l_extendedprice / 105000e0)"
reg("diff_bands", f"SELECT COUNT(*) AS n, {rnd_sql(f'AVG({_DD})')} AS mean_abs_diff, {rnd_sql(f'MAX({_DD})')} AS max_abs_diff, "
    + ", ".join(f"CAST(COUNT_IF({_DD} {op}) AS BIGINT) AS {n}" for n, op in [
        ("n_lt_1e4", "< 1e-4"), ("n_lt_01", "< 0.01e0"), ("n_lt_05", "< 0.05e0"), ("n_lt_10", "< 0.10e0"), ("n_ge_10", ">= 0.10e0")])
    + " FROM lineitem")


# ---------------------------------------------------------------- B26 / format labels

def _provenance_frame(spark, d):
    from riskframe.operators import features as FT
    from riskframe.operators import loan
    from riskframe.plans.q_features import POLY_COLS
    from riskframe.plans.q_marts import CREDIT_ACTIVE_VOCAB
    app = role(spark, d, "application")
    m = app.join(loan.rollup_bureau(role(spark, d, "bureau"), CREDIT_ACTIVE_VOCAB), "SK_ID_CURR", "left")
    return FT.poly_features(FT.domain_features(m), POLY_COLS, 2), app.columns


@query("feature_class")
def q_feature_class(spark, d):
    wide, raw = _provenance_frame(spark, d)
    t = P.feature_table(wide, ["SK_ID_CURR"])
    return t.withColumn("source", P.feature_source(F.col("feature"), raw))


def _feature_class_sql():
    import itertools
    from riskframe.plans.bind import _application
    from riskframe.plans.q_features import DOMAIN, POLY_COLS
    from riskframe.plans.q_marts import B_D, B_O, _bureau_final
    raw = [n for n, _ in _application("duckdb")]
    exprs = {c: c for c in raw if c != "SK_ID_CURR"}
    exprs["DAYS_EMPLOYED"] = "NULLIF(DAYS_EMPLOYED, 365243)"
    for c in B_O + B_D:
        exprs[c] = c
    for n, e, _ in DOMAIN:
        exprs[n] = e
    for a, b in itertools.combinations_with_replacement(POLY_COLS, 2):
        exprs[f"POLY_{a}_pow_2" if a == b else f"POLY_{a}_x_{b}"] = "1"   # median-filled: never NULL
    agg = set(["BUREAU_", "PREV_", "POS_", "CC_", "INST_"])

    def src(n):
        if n in raw:
            return "RW"
        if n.startswith("POLY_"):
            return "PL"
        if any(n.startswith(p) for p in agg):
            return "AG"
        return "DM"
    base = (f"(SELECT a.*, b.* EXCLUDE (SK_ID_CURR) FROM application a LEFT JOIN ({_bureau_final()}) b "
            "ON a.SK_ID_CURR = b.SK_ID_CURR) m")
    parts = [f"SELECT '{n}' AS feature, COUNT({e}) AS n_non_null, '{src(n)}' AS source FROM {base}" for n, e in exprs.items()]
    return with_roles("application", "bureau") + " UNION ALL ".join(parts)


reg("feature_class", _feature_class_sql())

LABEL_COLS = [("AMT_INCOME_TOTAL", False), ("AMT_CREDIT", False), ("EXT_SOURCE_1", False), ("OWN_CAR_AGE", True),
              ("CNT_CHILDREN", True)]


@query("format_labels")
def q_format_labels(spark, d):
    a = role(spark, d, "application")
    parts = []
    for c, integral in LABEL_COLS:
        parts.append(a.select("SK_ID_CURR", F.lit(c).alias("feature"),
                              P.format_label(F.lit(c), F.lit("RW"), F.col(c).isNull()).alias("label"),
                              P.format_value(F.col(c), integral).alias("value_text")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _fmt_sql(c, integral):
    if integral:
        return f"CASE WHEN {c} IS NULL THEN 'NA' ELSE format('{{:,}}', CAST({c} AS BIGINT)) END"
    return (f"CASE WHEN {c} IS NULL THEN 'NA' WHEN abs({c}) >= 1000 THEN format('{{:,.0f}}', CAST({c} AS DOUBLE)) "
            f"WHEN abs({c}) >= 1 THEN format('{{:,.2f}}', CAST({c} AS DOUBLE)) ELSE format('{{:,.4f}}', CAST({c} AS DOUBLE)) END")


reg("format_labels", with_roles("application") + " UNION ALL ".join(
    f"SELECT SK_ID_CURR, '{c}' AS feature, CASE WHEN {c} IS NULL THEN '[M] ' ELSE '' END || '{c} (RW)' AS label, "
    f"{_fmt_sql(c, i)} AS value_text FROM application" for c, i in LABEL_COLS))
