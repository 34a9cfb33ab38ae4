"""Streaming jobs with batch-twin oracles (M1-M8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.plans.q_io import LOG_SCHEMA, jsonl_log
from riskframe.plans.registry import query
from riskframe.plans.sqlgen import rnd_sql, round_double_cols
from riskframe.streaming import jobs as J

ORACLE: dict[str, str] = {}
PROB = "LEAST(value / 500e0, 1e0)"


def reg(k, s):
    ORACLE[k] = s


@query("stream_ingest")
def q_stream_ingest(spark, d):
    good, bad = J.ingest(spark, jsonl_log(spark, d), LOG_SCHEMA)
    g = good.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_events"))
    q = bad.agg(F.count(F.lit(1)).alias("n_events")).select(F.lit("_quarantine").alias("event_type"), "n_events")
    return g.unionByName(q)


reg("stream_ingest", "SELECT event_type, COUNT(*) AS n_events FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) <> 0 "
    "GROUP BY event_type UNION ALL SELECT '_quarantine', COUNT(*) FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) = 0")


@query("stream_tumbling")
def q_stream_tumbling(spark, d):
    return round_double_cols(J.tumbling(spark, d))


reg("stream_tumbling", (
    f"SELECT CAST(date_trunc('day', ts) AS VARCHAR) AS window_start, COUNT(*) AS n_predictions, {rnd_sql(f'AVG({PROB})')} AS avg_probability, "
    + ", ".join(f"CAST(COUNT_IF(CASE WHEN {PROB} < 0.3e0 THEN 'LOW' WHEN {PROB} < 0.5e0 THEN 'MEDIUM' ELSE 'HIGH' END = '{b}') AS BIGINT) AS n_{b.lower()}"
                for b in ("LOW", "MEDIUM", "HIGH")) + " FROM events GROUP BY 1"))


@query("stream_sliding")
def q_stream_sliding(spark, d):
    return round_double_cols(J.sliding(spark, d))


reg("stream_sliding", (
    "WITH starts AS (SELECT DISTINCT date_trunc('day', ts) - (i * INTERVAL 1 DAY) AS ws FROM events, range(0, 7) r(i)) "
    f"SELECT CAST(ws AS VARCHAR) AS window_start, COUNT(*) AS n, {rnd_sql('AVG(CAST(event_type = ' + chr(39) + 'error' + chr(39) + ' AS DOUBLE))')} AS default_rate "
    "FROM starts JOIN events ON events.ts >= ws AND events.ts < ws + INTERVAL 7 DAY GROUP BY ws"))


@query("stream_alerts")
def q_stream_alerts(spark, d):
    return round_double_cols(J.error_alerts(spark, d))


reg("stream_alerts", (
    f"SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS window_start, COUNT(*) AS n, {rnd_sql('AVG(CAST(event_type = ' + chr(39) + 'error' + chr(39) + ' AS DOUBLE))')} AS error_rate "
    "FROM events GROUP BY 1 HAVING AVG(CAST(event_type = 'error' AS DOUBLE)) > 0.05e0"))


@query("stream_dedup")
def q_stream_dedup(spark, d):
    return J.dedup(spark, d)


reg("stream_dedup", "SELECT event_type, COUNT(DISTINCT event_id) AS n_events FROM events GROUP BY event_type")


def _ref_edges(spark, d):
    from riskframe.plans.q_drift import events_split
    ref, _ = events_split(spark, d)
    from riskframe.operators.ordered import exact_quantiles
    q = exact_quantiles(ref, "value", [i / 10 for i in range(11)]).agg(
        F.array_sort(F.array_distinct(F.collect_list("quantile"))).alias("q"))
    return q.select(F.slice("q", 2, F.size("q") - 2).alias("inner"))


@query("stream_psi")
def q_stream_psi(spark, d):
    """PSI of the streamed current period against fixed reference deciles.
    (Unlike the batch PSI the outer edges are the reference's, fixed before
    the stream starts.)"""
    from riskframe.plans.q_drift import events_split
    edges = _ref_edges(spark, d)
    cur_counts = J.incremental_psi(spark, d, edges)
    ref, _ = events_split(spark, d)
    ref_counts = ref.crossJoin(F.broadcast(edges)).select(F.size(F.filter("inner", lambda x: x <= F.col("value"))).alias("bin")) \
        .groupBy("bin").agg(F.count(F.lit(1)).alias("r"))
    nb = edges.select((F.size("inner") + 1).alias("nb"))
    bins = nb.select(F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("bin"))
    full = bins.join(ref_counts, "bin", "left").join(cur_counts, "bin", "left").fillna(0, ["r", "c"])
    tot = full.agg(F.sum("r").alias("r_tot"), F.sum("c").alias("c_tot"))
    p = full.crossJoin(tot).select(((F.col("r") + 1e-6) / (F.col("r_tot") + 1e-6)).alias("rp"),
                                   ((F.col("c") + 1e-6) / (F.col("c_tot") + 1e-6)).alias("cp"))
    return round_double_cols(p.agg(F.sum((F.col("cp") - F.col("rp")) * F.log(F.col("cp") / F.col("rp"))).alias("psi")))


reg("stream_psi", (
    "WITH ref AS (SELECT value AS v FROM events WHERE ts < TIMESTAMP '2024-01-16 00:00:00'), "
    "cur AS (SELECT value * 1.2e0 AS v FROM events WHERE ts >= TIMESTAMP '2024-01-16 00:00:00'), "
    f"e AS (SELECT list_sort(list_distinct(quantile_cont(v, [{', '.join(str(i / 10) for i in range(11))}]))) AS q FROM ref), "
    "ed AS (SELECT q[2:len(q) - 1] AS inner_ FROM e), "
    "bins AS (SELECT UNNEST(range(0, len(inner_) + 1)) AS bin FROM ed), "
    "rc AS (SELECT len(list_filter(inner_, lambda x: x <= v)) AS bin, COUNT(*) AS r FROM ref, ed GROUP BY 1), "
    "cc AS (SELECT len(list_filter(inner_, lambda x: x <= v)) AS bin, COUNT(*) AS c FROM cur, ed GROUP BY 1), "
    "f AS (SELECT COALESCE(r, 0) AS r, COALESCE(c, 0) AS c FROM bins LEFT JOIN rc USING (bin) LEFT JOIN cc USING (bin)), "
    "p AS (SELECT (r + 1e-6) / (SUM(r) OVER () + 1e-6) AS rp, (c + 1e-6) / (SUM(c) OVER () + 1e-6) AS cp FROM f) "
    f"SELECT {rnd_sql('SUM((cp - rp) * ln(cp / rp))')} AS psi FROM p"))


@query("stream_score")
def q_stream_score(spark, d):
    from riskframe.plans.q_drift import events_split
    ref, _ = events_split(spark, d)
    state = ref.groupBy("event_type").agg(F.avg("value").alias("type_mean"))   # fitted on the reference period
    return round_double_cols(J.stream_static_score(spark, d, state))


reg("stream_score", (
    "WITH st AS (SELECT event_type, AVG(value) AS m FROM events WHERE ts < TIMESTAMP '2024-01-16 00:00:00' GROUP BY 1) "
    f"SELECT event_id, events.event_type, {rnd_sql('value')} AS value, {rnd_sql('value / (m + 1e-5)')} AS value_vs_type_mean "
    "FROM events LEFT JOIN st ON events.event_type = st.event_type"))


@query("stream_late")
def q_stream_late(spark, d):
    """M5: arrivals behind the watermark are dropped; the emitted windows are
    those of the first arrival that its watermark has passed."""
    windows, ev = J.late_data(spark, d)
    n = ev.agg(F.count(F.lit(1)).alias("n_rows_input"))
    return windows.agg(F.count(F.lit(1)).alias("n_windows_emitted"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows_emitted")).crossJoin(n).select(
        "n_rows_input", "n_windows_emitted", "n_rows_emitted")


reg("stream_late", (
    "WITH a AS (SELECT date_trunc('day', ts) AS w, COUNT(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-23 00:00:00' GROUP BY 1), "
    "e AS (SELECT * FROM a WHERE w + INTERVAL 1 DAY <= (SELECT MAX(ts) FROM events) - INTERVAL 1 DAY) "
    "SELECT (SELECT COUNT(*) FROM events) AS n_rows_input, COUNT(*) AS n_windows_emitted, CAST(COALESCE(SUM(n), 0) AS BIGINT) AS n_rows_emitted FROM e"))
