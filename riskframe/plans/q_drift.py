"""Drift tests bound to the events table (reference = before 2024-01-16,
current = after, with the value shifted by 20 %) and to the scored role."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.functions.exprs import hash_bigint
from riskframe.operators import drift as DR
from riskframe.plans.registry import query
from riskframe.plans.sqlgen import rnd_sql, round_double_cols

ORACLE: dict[str, str] = {}
SPLIT = "2024-01-16 00:00:00"
NUM = ["value", "k", "user_id"]


def reg(k, s):
    ORACLE[k] = s


def events_split(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet").withColumn(
        "k", F.get_json_object("props", "$.k").cast("double"))
    cut = F.lit(SPLIT).cast("timestamp")
    ref = ev.where(F.col("ts") < cut)
    cur = ev.where(F.col("ts") >= cut).withColumn("value", F.col("value") * F.lit(1.2))
    return ref, cur


EV = (f"WITH ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events), "
      f"ref AS (SELECT * FROM ev WHERE ts < TIMESTAMP '{SPLIT}'), "
      f"cur AS (SELECT * EXCLUDE (value), value * 1.2e0 AS value FROM ev WHERE ts >= TIMESTAMP '{SPLIT}')")


def long_sql(cols, side, src):
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value, '{side}' AS side FROM {src} "
                              f"WHERE {c} IS NOT NULL AND NOT isnan(CAST({c} AS DOUBLE))" for c in cols)


def ks_sql(cols, ref="ref", cur="cur"):
    both = f"{long_sql(cols, 'ref', ref)} UNION ALL {long_sql(cols, 'cur', cur)}"
    counts = (f"SELECT feature, value, CAST(COUNT_IF(side = 'ref') AS DOUBLE) AS n_ref, CAST(COUNT_IF(side = 'cur') AS DOUBLE) AS n_cur "
              f"FROM ({both}) b GROUP BY feature, value")
    cum = (f"SELECT feature, SUM(n_ref) OVER w AS cr, SUM(n_cur) OVER w AS cc, SUM(n_ref) OVER (PARTITION BY feature) AS NR, "
           f"SUM(n_cur) OVER (PARTITION BY feature) AS NC FROM ({counts}) c "
           f"WINDOW w AS (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING)")
    agg = f"SELECT feature, MAX(abs(cr / NR - cc / NC)) AS D, MAX(NR) AS NR, MAX(NC) AS NC FROM ({cum}) q GROUP BY feature"
    en = "(NR * NC / (NR + NC))"
    lam = f"((sqrt({en}) + 0.12e0 + 0.11e0 / sqrt({en})) * D)"
    series = (f"list_reduce(list_transform(range(1, 101), lambda j: 2e0 * (CASE WHEN j % 2 = 1 THEN 1e0 ELSE -1e0 END) "
              f"* exp(-2e0 * j * j * {lam} * {lam})), lambda a, b: a + b)")
    p = f"(CASE WHEN {lam} < 0.2e0 THEN 1e0 ELSE LEAST(GREATEST({series}, 0e0), 1e0) END)"
    feats = " UNION ALL ".join(f"SELECT '{c}' AS feature" for c in cols)
    return (f"SELECT f.feature, CASE WHEN COALESCE(NR, 0) * COALESCE(NC, 0) = 0 THEN 0e0 ELSE D END AS ks_statistic, "
            f"CASE WHEN COALESCE(NR, 0) * COALESCE(NC, 0) = 0 THEN 1e0 ELSE {p} END AS p_value "
            f"FROM ({feats}) f LEFT JOIN ({agg}) a ON f.feature = a.feature")


@query("ks_drift")
def q_ks(spark, d):
    ref, cur = events_split(spark, d)
    return round_double_cols(DR.ks_drift(ref, cur, NUM))


reg("ks_drift", EV + f" SELECT feature, {rnd_sql('ks_statistic')} AS ks_statistic, {rnd_sql('p_value')} AS p_value FROM ({ks_sql(NUM)}) k")


def psi_sql(cols, ref="ref", cur="cur"):
    parts = []
    for c in cols:
        r = f"(SELECT CAST({c} AS DOUBLE) AS v FROM {ref} WHERE {c} IS NOT NULL AND NOT isnan(CAST({c} AS DOUBLE)))"
        u = f"(SELECT CAST({c} AS DOUBLE) AS v FROM {cur} WHERE {c} IS NOT NULL AND NOT isnan(CAST({c} AS DOUBLE)))"
        q = f"(SELECT list_sort(list_distinct(quantile_cont(v, [{', '.join(str(i / 10) for i in range(11))}]))) AS q FROM {r} x)"
        edges = f"(SELECT q[2:len(q) - 1] AS inner_, len(q) - 1 AS nb FROM {q} e WHERE len(q) >= 2 AND (SELECT COUNT(*) FROM {u} z) > 0)"
        binned = (f"SELECT side, len(list_filter(inner_, lambda e: e <= v)) AS bin FROM "
                  f"(SELECT 'ref' AS side, v FROM {r} a UNION ALL SELECT 'cur', v FROM {u} b) s, {edges} ed")
        bins = f"SELECT UNNEST(range(0, nb)) AS bin FROM {edges} ed2"
        full = (f"SELECT b.bin, COALESCE(COUNT_IF(side = 'ref'), 0) AS rr, COALESCE(COUNT_IF(side = 'cur'), 0) AS cc "
                f"FROM ({bins}) b LEFT JOIN ({binned}) x ON b.bin = x.bin GROUP BY b.bin")
        props = (f"SELECT (rr + 1e-6) / (SUM(rr) OVER () + 1e-6) AS rp, (cc + 1e-6) / (SUM(cc) OVER () + 1e-6) AS cp FROM ({full}) f")
        parts.append(f"SELECT '{c}' AS feature, COALESCE((SELECT SUM((cp - rp) * ln(cp / rp)) FROM ({props}) p), 0e0) AS psi")
    return " UNION ALL ".join(parts)


@query("psi")
def q_psi(spark, d):
    ref, cur = events_split(spark, d)
    return round_double_cols(DR.psi(ref, cur, NUM))


reg("psi", EV + f" SELECT feature, {rnd_sql('psi')} AS psi FROM ({psi_sql(NUM)}) p")


@query("chi2_drift")
def q_chi2(spark, d):
    ref, cur = events_split(spark, d)
    return round_double_cols(DR.chi2_statistic(ref, cur, ["event_type"]))


reg("chi2_drift", EV + (
    " , c AS (SELECT value AS v, COUNT_IF(side = 'ref') AS r, COUNT_IF(side = 'cur') AS o FROM ("
    "SELECT event_type AS value, 'ref' AS side FROM ref UNION ALL SELECT event_type, 'cur' FROM cur) b "
    "WHERE value IS NOT NULL GROUP BY value) "
    "SELECT 'event_type' AS feature, "
    + rnd_sql("SUM(power(o - (r / (SELECT SUM(r) FROM c) + 1e-10) * (SELECT COUNT(*) FROM cur), 2) / "
              "((r / (SELECT SUM(r) FROM c) + 1e-10) * (SELECT COUNT(*) FROM cur)))")
    + " AS chi2_statistic, CAST(COUNT(*) - 1 AS BIGINT) AS dof FROM c"))


@query("categorical_drift")
def q_categorical_drift(spark, d):
    """Chi-square with its tail probability (pandas UDF on one row per feature)."""
    ref, cur = events_split(spark, d)
    return round_double_cols(DR.chi2_drift(ref, cur, ["event_type"]))


def drift_record_sql(cols, ref="ref", cur="cur"):
    mom = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, (SELECT AVG(CAST({c} AS DOUBLE)) FROM {ref} WHERE NOT isnan(CAST({c} AS DOUBLE))) AS reference_mean, "
        f"(SELECT AVG(CAST({c} AS DOUBLE)) FROM {cur} WHERE NOT isnan(CAST({c} AS DOUBLE))) AS current_mean, "
        f"(SELECT STDDEV_POP(CAST({c} AS DOUBLE)) FROM {ref} WHERE NOT isnan(CAST({c} AS DOUBLE))) AS reference_std, "
        f"(SELECT STDDEV_POP(CAST({c} AS DOUBLE)) FROM {cur} WHERE NOT isnan(CAST({c} AS DOUBLE))) AS current_std" for c in cols)
    L = DR.NUMERIC_LABELS
    interp = (f"CASE WHEN k.p_value > 0.05e0 THEN '{L[0]}' WHEN p.psi < 0.1e0 THEN '{L[1]}' WHEN p.psi < 0.25e0 THEN '{L[2]}' "
              f"ELSE '{L[3]}' END")
    return (f"SELECT k.feature, 'KS' AS drift_test, {rnd_sql('round_even(k.ks_statistic, 4)')} AS ks_statistic, "
            f"{rnd_sql('round_even(k.p_value, 4)')} AS p_value, {rnd_sql('round_even(p.psi, 4)')} AS psi, "
            f"k.p_value < 0.05e0 AS is_drifted, {interp} AS interpretation, {rnd_sql('m.reference_mean')} AS reference_mean, "
            f"{rnd_sql('m.current_mean')} AS current_mean, {rnd_sql('m.reference_std')} AS reference_std, "
            f"{rnd_sql('m.current_std')} AS current_std "
            f"FROM ({ks_sql(cols, ref, cur)}) k JOIN ({psi_sql(cols, ref, cur)}) p ON k.feature = p.feature "
            f"JOIN ({mom}) m ON k.feature = m.feature")


@query("drift_record")
def q_drift_record(spark, d):
    ref, cur = events_split(spark, d)
    return round_double_cols(DR.drift_record(ref, cur, ["value", "k"]))


reg("drift_record", EV + " " + drift_record_sql(["value", "k"]))


@query("batch_drift")
def q_batch_drift(spark, d):
    ref, cur = events_split(spark, d)
    return round_double_cols(DR.batch_drift(ref, cur, exclude=["event_id"]))


reg("batch_drift", EV + " " + drift_record_sql(["user_id", "value", "k"]))


@query("drift_summary")
def q_drift_summary(spark, d):
    ref, cur = events_split(spark, d)
    return round_double_cols(DR.drift_summary(DR.batch_drift(ref, cur, exclude=["event_id"])))


reg("drift_summary", EV + (f" SELECT COUNT(*) AS n_features, CAST(COUNT_IF(is_drifted) AS BIGINT) AS n_drifted, "
                           f"{rnd_sql('round_even(COUNT_IF(is_drifted) * 100e0 / COUNT(*), 2)')} AS drift_pct FROM ("
                           + drift_record_sql(["user_id", "value", "k"]) + ") r"))


@query("prediction_drift")
def q_prediction_drift(spark, d):
    ref, cur = events_split(spark, d)
    p = F.least(F.col("value") / F.lit(500.0), F.lit(1.0)).alias("probability")
    return round_double_cols(DR.prediction_drift(ref.select(p), cur.select(p), "probability"))


def _pred_drift_sql():
    src = ("ref2 AS (SELECT LEAST(value / 500e0, 1e0) AS probability FROM ref), "
           "cur2 AS (SELECT LEAST(value / 500e0, 1e0) AS probability FROM cur)")
    ks = ks_sql(["probability"], "ref2", "cur2")
    return (EV + ", " + src + f" SELECT {rnd_sql('k.ks_statistic')} AS ks_statistic, {rnd_sql('k.p_value')} AS p_value, "
            f"{rnd_sql('rm')} AS reference_mean, {rnd_sql('cm')} AS current_mean, {rnd_sql('cm - rm')} AS mean_shift, "
            f"{rnd_sql('(cm - rm) * 100e0 / NULLIF(rm, 0)')} AS pct_shift FROM ({ks}) k, "
            "(SELECT AVG(probability) AS rm FROM ref2), (SELECT AVG(probability) AS cm FROM cur2)")


reg("prediction_drift", _pred_drift_sql())


@query("target_drift")
def q_target_drift(spark, d):
    from riskframe.plans.q_features import scored
    li = spark.read.parquet(f"{d}/lineitem.parquet").select(
        F.year("l_shipdate").alias("y"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("TARGET"))
    return round_double_cols(DR.target_drift(li.where("y <= 1997"), li.where("y > 1997"), "TARGET"))


reg("target_drift", (
    "WITH li AS (SELECT year(l_shipdate) AS y, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS TARGET FROM lineitem), "
    "r AS (SELECT TARGET AS cls, COUNT(*) AS a FROM li WHERE y <= 1997 GROUP BY 1), "
    "c AS (SELECT TARGET AS cls, COUNT(*) AS b FROM li WHERE y > 1997 GROUP BY 1), "
    "t AS (SELECT COALESCE(r.cls, c.cls) AS cls, COALESCE(a, 0) AS a, COALESCE(b, 0) AS b FROM r FULL JOIN c ON r.cls = c.cls), "
    "tot AS (SELECT SUM(a) AS TA, SUM(b) AS TB, COUNT(*) AS k FROM t), "
    "j AS (SELECT *, TA * (a + b) / (TA + TB) AS ea, TB * (a + b) / (TA + TB) AS eb, CASE WHEN k = 2 THEN 0.5e0 ELSE 0e0 END AS yc FROM t, tot) "
    f"SELECT {rnd_sql('SUM(power(GREATEST(abs(a - ea) - yc, 0e0), 2) / ea + power(GREATEST(abs(b - eb) - yc, 0e0), 2) / eb)')} "
    "AS chi2_statistic, CAST(MAX(k) - 1 AS BIGINT) AS dof, "
    f"{rnd_sql('SUM(CASE WHEN cls = 1 THEN a END) / MAX(TA)')} AS reference_positive_rate, "
    f"{rnd_sql('SUM(CASE WHEN cls = 1 THEN b END) / MAX(TB)')} AS current_positive_rate FROM j"))


def hash_share(df, key: str, share: float, seed=42):
    """The rows whose md5 hash of (key, seed) falls in the lowest ``share``: a
    sample that grows with the table."""
    return df.where(hash_bigint(key, seed=seed).cast("double") < F.lit(share * 4294967296.0))


@query("sampled_drift")
def q_sampled_drift(spark, d):
    """Drift on hash samples: 40 % of the reference, 10 % of the current rows."""
    ref, cur = events_split(spark, d)
    return round_double_cols(DR.drift_record(hash_share(ref, "event_id", 0.4), hash_share(cur, "event_id", 0.1), ["value", "k"]))


def _hs_sql(src, share):
    return (f"(SELECT * FROM {src} WHERE CAST('0x' || substr(md5(CAST(event_id AS VARCHAR) || '_42'), 1, 8) AS BIGINT) < {share * 4294967296.0!r}e0)")


reg("sampled_drift", EV + f", rs AS {_hs_sql('ref', 0.4)}, cs AS {_hs_sql('cur', 0.1)} " + drift_record_sql(["value", "k"], "rs", "cs"))


def monitoring_metrics(spark, d):
    """Metric table (metric, value) derived from the driver tables."""
    from riskframe.operators import metrics as M
    from riskframe.plans.q_features import scored
    s = scored(spark, d)
    auc = M.roc_auc(s, "TARGET", "PROBABILITY2").select(F.lit("auc").alias("metric"), F.col("roc_auc").alias("value"))
    rate = s.agg(F.avg("TARGET").alias("value")).select(F.lit("default_rate").alias("metric"), "value")
    ev = spark.read.parquet(f"{d}/events.parquet")
    err = ev.agg(F.avg((F.col("event_type") == "error").cast("double")).alias("value")).select(
        F.lit("error_rate").alias("metric"), "value")
    ref, cur = events_split(spark, d)
    dr = DR.drift_summary(DR.batch_drift(ref, cur, exclude=["event_id"]))
    share = dr.select(F.lit("drift_share").alias("metric"), (F.col("n_drifted") / F.col("n_features")).alias("value"))
    return auc.unionByName(rate).unionByName(err).unionByName(share)


# fixed values: monitoring alert rules (metric, comparison, threshold, severity)
ALERT_RULES = [
    ("high_default_rate", "default_rate", ">", 0.15, "critical"),
    ("low_auc", "auc", "<", 0.70, "critical"),
    ("feature_drift", "drift_share", ">", 0.10, "warning"),
    ("high_error_rate", "error_rate", ">", 0.05, "warning"),
]


@query("alert_rules")
def q_alert_rules(spark, d):
    m = monitoring_metrics(spark, d)
    rules = spark.createDataFrame(ALERT_RULES, "rule string, metric string, op string, threshold double, severity string")
    j = m.join(F.broadcast(rules), "metric")
    fired = F.when(F.col("op") == ">", F.col("value") > F.col("threshold")).when(
        F.col("op") == "<", F.col("value") < F.col("threshold")).otherwise(F.lit(False))
    return round_double_cols(j.select("rule", "metric", "value", "threshold", "severity", fired.alias("fired")))


@query("retrain_trigger")
def q_retrain(spark, d):
    m = monitoring_metrics(spark, d)
    w = m.groupBy().pivot("metric", ["auc", "drift_share"]).agg(F.first("value"))
    reasons = F.array_compact(F.array(F.when(F.col("auc") < 0.70, F.lit("auc below 0.70")),
                                      F.when(F.col("drift_share") > 0.10, F.lit("drift share above 10%"))))
    return round_double_cols(w.select("auc", "drift_share", (F.size(reasons) > 0).alias("retrain"), reasons.alias("reasons")))


@query("drift_persist")
def q_drift_persist(spark, d):
    """Drift records stored under a batch id -- twice, as a rerun does -- and read back."""
    from riskframe.sources.io import materialize, scratch_path
    ref, cur = events_split(spark, d)
    rec = materialize(DR.batch_drift(ref, cur, exclude=["event_id"]), "drift-records")
    path = scratch_path(spark, "drift")
    DR.persist_drift(rec, path, "2024-01-16")
    return round_double_cols(DR.persist_drift(rec, path, "2024-01-16").drop("recorded_at"))


reg("drift_persist", EV + " SELECT r.*, '2024-01-16' AS batch_id FROM (" + drift_record_sql(["user_id", "value", "k"]) + ") r")


def _metrics_sql():
    from riskframe.plans.q_features import SCORED_SQL
    return (EV + f", sc AS ({SCORED_SQL}), "
            "pc AS (SELECT PROBABILITY2 AS p, COUNT_IF(TARGET = 1) AS pos, COUNT_IF(TARGET <> 1) AS neg FROM sc WHERE PROBABILITY2 IS NOT NULL GROUP BY 1), "
            "pw AS (SELECT pos, neg, COALESCE(SUM(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM pc), "
            "m AS (SELECT 'auc' AS metric, (SELECT SUM(pos * (below + neg / 2e0)) / (SUM(pos) * SUM(neg)) FROM pw) AS value UNION ALL "
            "SELECT 'default_rate', AVG(TARGET) FROM sc UNION ALL SELECT 'error_rate', AVG(CAST(event_type = 'error' AS DOUBLE)) FROM events UNION ALL "
            "SELECT 'drift_share', COUNT_IF(is_drifted) / COUNT(*) FROM (" + drift_record_sql(["user_id", "value", "k"]) + ") r) ")


def _alert_sql():
    rules = ", ".join(f"('{r}', '{m}', '{op}', {t}e0, '{s}')" for r, m, op, t, s in ALERT_RULES)
    return (_metrics_sql() + f", rules(rule, metric, op, threshold, severity) AS (VALUES {rules}) SELECT rule, metric, {rnd_sql('value')} AS value, "
            f"{rnd_sql('threshold')} AS threshold, severity, CASE op WHEN '>' THEN value > threshold WHEN '<' THEN value < threshold ELSE FALSE END AS fired "
            "FROM rules JOIN m USING (metric)")


reg("alert_rules", _alert_sql())
reg("retrain_trigger", _metrics_sql() + (
    ", w AS (SELECT MAX(value) FILTER (metric = 'auc') AS auc, MAX(value) FILTER (metric = 'drift_share') AS drift_share FROM m), "
    "x AS (SELECT *, list_filter([CASE WHEN auc < 0.70e0 THEN 'auc below 0.70' END, CASE WHEN drift_share > 0.10e0 THEN 'drift share above 10%' END], lambda y: y IS NOT NULL) AS reasons FROM w) "
    f"SELECT {rnd_sql('auc')} AS auc, {rnd_sql('drift_share')} AS drift_share, len(reasons) > 0 AS retrain, reasons FROM x"))
