"""Evaluation queries over the scored-lineitem role."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.operators import metrics as M
from riskframe.plans.q_features import SCORED_SQL, scored
from riskframe.plans.registry import query
from riskframe.plans.sqlgen import rnd_sql, round_double_cols

ORACLE: dict[str, str] = {}
W = f"WITH s AS ({SCORED_SQL})"


def reg(k, s):
    ORACLE[k] = s


def z(num, den):
    return f"COALESCE(CAST({num} AS DOUBLE) / NULLIF(CAST({den} AS DOUBLE), 0), 0e0)"


def rates_sql(tp="tp", fp="fp", fn="fn", tn="tn", beta=M.BETA):
    b2 = beta * beta
    prec, rec = z(tp, f"{tp} + {fp}"), z(tp, f"{tp} + {fn}")
    return {
        "accuracy": z(f"{tp} + {tn}", f"{tp} + {fp} + {fn} + {tn}"), "precision": prec, "recall": rec,
        "f1": z(f"2e0 * {prec} * {rec}", f"{prec} + {rec}"),
        "fbeta": z(f"{1 + b2!r}e0 * {prec} * {rec}" if "e" not in repr(1 + b2) else f"{1 + b2!r} * {prec} * {rec}",
                   f"{b2!r} * {prec} + {rec}"),
        "fpr": z(fp, f"{fp} + {tn}"), "fnr": z(fn, f"{fn} + {tp}"),
        "cost": f"CAST(10e0 * {fn} + 1e0 * {fp} AS DOUBLE)"}


def rates_select(src, keys=(), ints=("tp", "fp", "fn", "tn")):
    r = rates_sql()
    sel = list(keys) + [f"CAST({c} AS BIGINT) AS {c}" for c in ints] + [f"{rnd_sql(e)} AS {n}" for n, e in r.items()]
    return f"SELECT {', '.join(sel)} FROM ({src}) x"


CONF = ("SELECT COUNT_IF(TARGET = 1 AND PROBABILITY >= 0.5e0) AS tp, COUNT_IF(TARGET = 0 AND PROBABILITY >= 0.5e0) AS fp, "
        "COUNT_IF(TARGET = 1 AND PROBABILITY < 0.5e0) AS fn, COUNT_IF(TARGET = 0 AND PROBABILITY < 0.5e0) AS tn FROM s")


@query("confusion")
def q_confusion(spark, d):
    s = scored(spark, d).withColumn("PRED", (F.col("PROBABILITY") >= 0.5).cast("bigint"))
    return round_double_cols(M.confusion(s, "TARGET", "PRED"))


reg("confusion", W + (
    ", g AS (SELECT TARGET AS actual, CAST(PROBABILITY >= 0.5e0 AS BIGINT) AS predicted, COUNT(*) AS count FROM s GROUP BY ALL) "
    f"SELECT actual, predicted, count, {rnd_sql('count / SUM(count) OVER (PARTITION BY actual)')} AS row_share FROM g"))


@query("class_metrics")
def q_class_metrics(spark, d):
    return round_double_cols(M.class_metrics(scored(spark, d), "TARGET", "PROBABILITY", 0.5))


reg("class_metrics", W + " " + rates_select(CONF))


@query("threshold_metrics")
def q_threshold_metrics(spark, d):
    return round_double_cols(M.class_metrics(scored(spark, d), "TARGET", "PROBABILITY2", 0.3282))


reg("threshold_metrics", W + " " + rates_select(CONF.replace("PROBABILITY >= 0.5e0", "PROBABILITY2 >= 0.3282e0")
                                                .replace("PROBABILITY < 0.5e0", "PROBABILITY2 < 0.3282e0")))


def curve_sql(score="PROBABILITY", src="s", groups=()):
    g = ", ".join(groups)
    gp = f"PARTITION BY {g} " if groups else ""
    gsel = f"{g}, " if groups else ""
    return (f"SELECT *, SUM(pos) OVER ({gp}ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp, "
            f"SUM(neg) OVER ({gp}ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp, "
            f"SUM(pos) OVER ({gp[:-1] if gp else ''}) AS P, SUM(neg) OVER ({gp[:-1] if gp else ''}) AS N FROM ("
            f"SELECT {gsel}CAST({score} AS DOUBLE) AS score, CAST(COUNT_IF(TARGET = 1) AS DOUBLE) AS pos, "
            f"CAST(COUNT_IF(TARGET <> 1) AS DOUBLE) AS neg FROM {src} WHERE {score} IS NOT NULL GROUP BY ALL) st")


@query("roc_auc")
def q_roc_auc(spark, d):
    s = scored(spark, d)
    a = M.roc_auc(s, "TARGET", "PROBABILITY").withColumnRenamed("roc_auc", "auc_quantity")
    b = M.roc_auc(s, "TARGET", "PROBABILITY2").withColumnRenamed("roc_auc", "auc_price")
    return round_double_cols(a.crossJoin(b))


reg("roc_auc", W + (
    f"SELECT (SELECT {rnd_sql('SUM(neg * (2e0 * tp - pos) / 2e0) / (MAX(P) * MAX(N))')} FROM ({curve_sql()}) c) AS auc_quantity, "
    f"(SELECT {rnd_sql('SUM(neg * (2e0 * tp - pos) / 2e0) / (MAX(P) * MAX(N))')} FROM ({curve_sql('PROBABILITY2')}) c) AS auc_price"))


@query("avg_precision")
def q_avg_precision(spark, d):
    s = scored(spark, d)
    a = M.average_precision(s, "TARGET", "PROBABILITY").withColumnRenamed("average_precision", "ap_quantity")
    b = M.average_precision(s, "TARGET", "PROBABILITY2").withColumnRenamed("average_precision", "ap_price")
    return round_double_cols(a.crossJoin(b))


AP = "SUM(CASE WHEN P > 0 THEN pos / P * (tp / (tp + fp)) END)"
reg("avg_precision", W + (
    f"SELECT (SELECT {rnd_sql(AP)} FROM ({curve_sql()}) c) AS ap_quantity, "
    f"(SELECT {rnd_sql(AP)} FROM ({curve_sql('PROBABILITY2')}) c) AS ap_price"))


@query("roc_points")
def q_roc_points(spark, d):
    return round_double_cols(M.roc_points(scored(spark, d), "TARGET", "PROBABILITY2"))


reg("roc_points", W + f"SELECT {rnd_sql('score')} AS threshold, {rnd_sql(z('fp', 'N'))} AS fpr, {rnd_sql(z('tp', 'P'))} AS tpr "
    f"FROM ({curve_sql('PROBABILITY2')}) c")


@query("pr_points")
def q_pr_points(spark, d):
    return round_double_cols(M.pr_points(scored(spark, d), "TARGET", "PROBABILITY"))


reg("pr_points", W + f"SELECT {rnd_sql('score')} AS threshold, {rnd_sql(z('tp', 'tp + fp'))} AS precision, "
    f"{rnd_sql(z('tp', 'P'))} AS recall FROM ({curve_sql('PROBABILITY')}) c")


@query("best_fbeta")
def q_best_fbeta(spark, d):
    return round_double_cols(M.best_fbeta(scored(spark, d), "TARGET", "PROBABILITY2"))


def _fbeta_sql(score="PROBABILITY2", groups=(), src="s"):
    b2 = M.BETA ** 2
    fb = z(f"{1 + b2!r} * tp", f"{1 + b2!r} * tp + {b2!r} * (P - tp) + fp")
    g = ", ".join(groups)
    return (f"SELECT {g + ', ' if g else ''}{rnd_sql('fb')} AS best_fbeta, {rnd_sql('score')} AS best_threshold, "
            f"{rnd_sql('cost')} AS cost, {rnd_sql('cost / (P + N)')} AS avg_cost FROM ("
            f"SELECT *, ROW_NUMBER() OVER ({'PARTITION BY ' + g + ' ' if g else ''}ORDER BY fb DESC, score ASC) AS rn FROM ("
            f"SELECT *, {fb} AS fb, 10e0 * (P - tp) + 1e0 * fp AS cost FROM ({curve_sql(score, src, groups)}) c) c2) c3 WHERE rn = 1")


reg("best_fbeta", W + " " + _fbeta_sql())


def _grid_k_sql(score="PROBABILITY", start=0.01, step=0.01, n=99):
    est = f"CAST(FLOOR(({score} - {start!r}) / {step!r}) AS BIGINT)"
    t0 = f"({start!r} + CAST({est} AS DOUBLE) * {step!r})"
    t1 = f"({start!r} + CAST({est} + 1 AS DOUBLE) * {step!r})"
    k = f"({est} + CASE WHEN {t0} <= {score} THEN 1 ELSE 0 END + CASE WHEN {t1} <= {score} THEN 1 ELSE 0 END)"
    return f"LEAST(GREATEST({k}, 0), {n})"


SWEEP_SRC = (f"SELECT i, 0.01e0 + CAST(i AS DOUBLE) * 0.01e0 AS threshold, "
             "COALESCE(SUM(CASE WHEN k > i THEN pos END), 0) AS tp, COALESCE(SUM(CASE WHEN k > i THEN neg END), 0) AS fp, "
             "COALESCE(SUM(CASE WHEN k <= i THEN pos END), 0) AS fn, COALESCE(SUM(CASE WHEN k <= i THEN neg END), 0) AS tn "
             "FROM range(99) t(i), (SELECT " + _grid_k_sql("PROBABILITY2") + " AS k, COUNT_IF(TARGET = 1) AS pos, "
             "COUNT_IF(TARGET <> 1) AS neg FROM s WHERE PROBABILITY2 IS NOT NULL GROUP BY ALL) h GROUP BY i")


def _sweep_sql():
    r = rates_sql()
    inner = (f"SELECT {rnd_sql('threshold')} AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, "
             f"CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, "
             + ", ".join(f"{rnd_sql(e)} AS {n}" for n, e in r.items()) + f", threshold AS raw_t, {r['cost']} AS raw_cost "
             f"FROM ({SWEEP_SRC}) x")
    return (W + f" SELECT * EXCLUDE (raw_t, raw_cost, rn), rn = 1 AS is_optimal FROM ("
            f"SELECT *, ROW_NUMBER() OVER (ORDER BY raw_cost, raw_t) AS rn FROM ({inner}) y) z")


@query("threshold_sweep")
def q_threshold_sweep(spark, d):
    return round_double_cols(M.threshold_sweep(scored(spark, d), "TARGET", "PROBABILITY2"))


reg("threshold_sweep", _sweep_sql())


@query("nearest_threshold")
def q_nearest(spark, d):
    sw = M.threshold_sweep(scored(spark, d), "TARGET", "PROBABILITY2")
    return round_double_cols(M.nearest_threshold(sw, 0.3282))


reg("nearest_threshold", _sweep_sql().replace("rn = 1 AS is_optimal FROM (", "rn = 1 AS is_optimal FROM (", 1)
    .rstrip() + " QUALIFY ROW_NUMBER() OVER (ORDER BY abs(z.raw_t - 0.3282e0), z.raw_t) = 1")


@query("score_hist")
def q_score_hist(spark, d):
    return round_double_cols(M.score_hist(scored(spark, d), "TARGET", "PROBABILITY2"))


reg("score_hist", W + (
    ", h AS (SELECT TARGET AS label, CAST(LEAST(FLOOR((PROBABILITY2 - 0e0) / 0.02e0), 49) AS BIGINT) AS bin, COUNT(*) AS count "
    "FROM s WHERE PROBABILITY2 BETWEEN 0 AND 1 GROUP BY ALL) "
    f"SELECT label, bin, {rnd_sql('0e0 + bin * 0.02e0')} AS bin_start, count, "
    f"{rnd_sql('count / (SUM(count) OVER (PARTITION BY label) * 0.02e0)')} AS density FROM h"))


def _models(spark, d):
    s = scored(spark, d)
    return s.select("TARGET", F.lit("quantity_model").alias("model"), F.col("PROBABILITY").alias("score")).unionByName(
        s.select("TARGET", F.lit("price_model").alias("model"), F.col("PROBABILITY2").alias("score")))


MODELS_SQL = ("SELECT TARGET, 'quantity_model' AS model, PROBABILITY AS score FROM s UNION ALL "
              "SELECT TARGET, 'price_model', PROBABILITY2 FROM s")


@query("model_compare")
def q_model_compare(spark, d):
    m = _models(spark, d)
    return round_double_cols(M.curve_metrics(m, "TARGET", "score", ["model"]).orderBy(F.col("roc_auc").desc()))


reg("model_compare", W + f", m AS ({MODELS_SQL}) SELECT a.model, roc_auc, average_precision, best_fbeta, best_threshold, cost, avg_cost FROM "
    f"(SELECT model, {rnd_sql('SUM(neg * (2e0 * tp - pos) / 2e0) / (MAX(P) * MAX(N))')} AS roc_auc, {rnd_sql(AP)} AS average_precision "
    f"FROM ({curve_sql('score', 'm', ['model'])}) c GROUP BY model) a JOIN ({_fbeta_sql('score', ['model'], 'm')}) f ON a.model = f.model")


@query("business_cost")
def q_business_cost(spark, d):
    c = M.class_metrics(scored(spark, d), "TARGET", "PROBABILITY", 0.5)
    return round_double_cols(c.select("cost", (F.col("cost") / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")))
                                      .alias("avg_cost_per_client")))


reg("business_cost", W + f" SELECT {rnd_sql('10e0 * fn + fp')} AS cost, {rnd_sql('(10e0 * fn + fp) / (tp + fp + fn + tn)')} "
    f"AS avg_cost_per_client FROM ({CONF}) c")


@query("dummy_baseline")
def q_dummy(spark, d):
    s = scored(spark, d)
    rate = s.agg(F.avg("TARGET").alias("__r"))
    dummy = s.crossJoin(rate).withColumn("score", F.col("__r"))   # constant no-skill score
    auc = M.roc_auc(dummy, "TARGET", "score")
    ap = M.average_precision(dummy, "TARGET", "score")
    cm = M.class_metrics(dummy.withColumn("maj", F.lit(0.0)), "TARGET", "maj", 0.5).select("accuracy", "cost")
    return round_double_cols(auc.crossJoin(ap).crossJoin(cm).crossJoin(rate.withColumnRenamed("__r", "positive_rate")))


reg("dummy_baseline", W + (
    f" SELECT {rnd_sql('0.5e0')} AS roc_auc, {rnd_sql('AVG(TARGET)')} AS average_precision, "
    f"{rnd_sql('COUNT_IF(TARGET = 0) / COUNT(*)')} AS accuracy, {rnd_sql('10e0 * COUNT_IF(TARGET = 1)')} AS cost, "
    f"{rnd_sql('AVG(TARGET)')} AS positive_rate FROM s"))


@query("class_report")
def q_class_report(spark, d):
    s = scored(spark, d).withColumn("PRED", (F.col("PROBABILITY") >= 0.5).cast("bigint"))
    return round_double_cols(M.class_report(s, "TARGET", "PRED"))


def _class_report_sql():
    src = "SELECT TARGET AS y, CAST(PROBABILITY >= 0.5e0 AS BIGINT) AS p FROM s"
    parts = []
    for cls in (0, 1):
        tp, fp, fn = (f"COUNT_IF(y = {cls} AND p = {cls})", f"COUNT_IF(y <> {cls} AND p = {cls})",
                      f"COUNT_IF(y = {cls} AND p <> {cls})")
        pr, rc = z(tp, f"{tp} + {fp}"), z(tp, f"{tp} + {fn}")
        parts.append(f"SELECT CAST({cls} AS BIGINT) AS class, {rnd_sql(pr)} AS precision, {rnd_sql(rc)} AS recall, "
                     f"{rnd_sql(z(f'2e0 * {pr} * {rc}', f'{pr} + {rc}'))} AS f1, CAST({tp} + {fn} AS BIGINT) AS support FROM ({src}) q")
    return W + " " + " UNION ALL ".join(parts)


reg("class_report", _class_report_sql())


@query("sweep_materialized")
def q_sweep_materialized(spark, d):
    """The sweep written to Parquet and reloaded."""
    from riskframe.sources.io import scratch_path
    sw = M.threshold_sweep(scored(spark, d), "TARGET", "PROBABILITY2")
    return round_double_cols(M.materialize(sw, scratch_path(spark, "sweep")))


reg("sweep_materialized", ORACLE["threshold_sweep"])
