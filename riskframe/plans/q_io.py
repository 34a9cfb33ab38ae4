"""Sources, sinks and JSON (A) plus operational tables (L)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.operators import ops as O
from riskframe.operators.profile import batches, prediction_log
from riskframe.plans.q_features import LKEY
from riskframe.plans.registry import query
from riskframe.plans.sqlgen import rnd_sql, round_double_cols
from riskframe.sources import io as IO
from riskframe.sources.batches import purge, read_batches, write_batch

ORACLE: dict[str, str] = {}
CUSTOMER_SCHEMA = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()),
                                T.StructField("c_nationkey", T.IntegerType()), T.StructField("c_acctbal", T.DoubleType()),
                                T.StructField("c_mktsegment", T.StringType())])


def reg(k, s):
    ORACLE[k] = s


def T_(spark, d, t):
    return spark.read.parquet(f"{d}/{t}.parquet")


@query("src_csv_roundtrip")
def q_csv_roundtrip(spark, d):
    path = IO.write_csv(T_(spark, d, "customer"), IO.scratch_path(spark, "customer-csv"))
    return round_double_cols(IO.read_csv(spark, path, CUSTOMER_SCHEMA))


reg("src_csv_roundtrip", f"SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, {rnd_sql('c_acctbal')} AS c_acctbal, c_mktsegment FROM customer")


@query("scan_pruned")
def q_scan_pruned(spark, d):
    # two columns + a filter: the scan's ReadSchema / PushedFilters show both
    return T_(spark, d, "lineitem").where(F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp")).select(
        "l_orderkey", "l_quantity")


reg("scan_pruned", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01'")


@query("scan_limit")
def q_scan_limit(spark, d):
    return T_(spark, d, "orders").orderBy("o_orderkey").limit(100).select("o_orderkey", "o_custkey", "o_orderstatus")


reg("scan_limit", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 100")

LOG_SCHEMA = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("timestamp", T.StringType()),
                           T.StructField("event_type", T.StringType()), T.StructField("latency_ms", T.DoubleType()),
                           T.StructField("user_id", T.LongType())])


def jsonl_log(spark, d):
    """Write the events as a JSON-lines log (lines of k == 0 truncated = malformed)."""
    ev = T_(spark, d, "events")
    line = F.to_json(F.struct("event_id", F.col("ts").cast("string").alias("timestamp"), "event_type",
                              F.col("value").alias("latency_ms"), "user_id"))
    bad = F.get_json_object("props", "$.k").cast("int") == 0
    path = IO.scratch_path(spark, "log-jsonl")
    ev.select(F.when(bad, F.substring(line, 1, 25)).otherwise(line).alias("value")).write.text(path)
    return path


@query("log_route")
def q_log_route(spark, d):
    log = IO.read_jsonl_log(spark, jsonl_log(spark, d), LOG_SCHEMA)
    return round_double_cols(log.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_events"),
                                                           F.avg("latency_ms").alias("avg_latency_ms")))


reg("log_route", f"SELECT event_type, COUNT(*) AS n_events, {rnd_sql('AVG(value)')} AS avg_latency_ms FROM events "
    "WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) <> 0 GROUP BY event_type")


@query("csv_to_parquet")
def q_csv_to_parquet(spark, d):
    csv = IO.write_csv(T_(spark, d, "customer"), IO.scratch_path(spark, "conv-csv"))
    return IO.csv_to_parquet(spark, csv, CUSTOMER_SCHEMA, IO.scratch_path(spark, "conv-pq"))


reg("csv_to_parquet", "SELECT COUNT(*) AS rows_in, COUNT(*) AS rows_out, CAST(5 AS BIGINT) AS cols_in, CAST(5 AS BIGINT) AS cols_out, true AS ok FROM customer")


@query("compact_files")
def q_compact(spark, d):
    base = IO.scratch_path(spark, "small-files")
    c = T_(spark, d, "customer")
    for seg in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"):   # many small files per segment
        IO.write_csv(c.where(F.col("c_mktsegment") == seg).repartition(4), f"{base}/customer_{seg.lower()}")
    merged = IO.compact(spark, f"{base}/customer_*", CUSTOMER_SCHEMA, IO.scratch_path(spark, "compacted"))
    return merged.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n_rows"))


reg("compact_files", "SELECT c_mktsegment, COUNT(*) AS n_rows FROM customer GROUP BY c_mktsegment")


@query("topk_wide_export")
def q_topk_wide(spark, d):
    from riskframe.plans.q_profiles import contributions
    c = contributions(spark, d)
    keyed = F.transform("contribs", lambda s: F.struct(F.abs(s["contribution"]).alias("a"), s["feature"].alias("feature"),
                                                        s["contribution"].alias("contribution")))
    top = F.slice(F.sort_array(keyed, asc=False), 1, 3)
    cols = []
    for i in range(3):
        cols += [top[i]["feature"].alias(f"feature_{i + 1}"), F.round(top[i]["contribution"], 6).alias(f"shap_{i + 1}")]
    return c.select(*LKEY, *cols)


def _wide_sql():
    from riskframe.plans.q_profiles import CONTRIB, LI_SEL
    structs = ", ".join(f"{{'a': abs(({e}) * {w}), 'feature': '{n}', 'contribution': ({e}) * {w}}}" for n, e, w in CONTRIB)
    sel = ", ".join(f"t[{i + 1}].feature AS feature_{i + 1}, round(t[{i + 1}].contribution, 6) AS shap_{i + 1}" for i in range(3))
    return f"SELECT {LI_SEL}, {sel} FROM (SELECT *, list_reverse_sort([{structs}]) AS t FROM lineitem) x"


reg("topk_wide_export", _wide_sql())


@query("json_safe")
def q_json_safe(spark, d):
    ev = T_(spark, d, "events").select(
        "event_id", F.when(F.col("event_type") == "error", F.lit(float("inf"))).when(
            F.col("event_type") == "signup", F.lit(float("nan"))).otherwise(F.col("value")).alias("score"),
        F.array(F.col("value"), F.when(F.col("event_type") == "view", F.lit(float("-inf"))).otherwise(F.lit(1.0))).alias("scores"))
    return round_double_cols(IO.json_safe_df(ev).select("event_id", "score",
                                                        F.transform("scores", lambda x: F.round(x, 6)).alias("scores")))


reg("json_safe", f"SELECT event_id, CASE WHEN event_type IN ('error', 'signup') THEN NULL ELSE {rnd_sql('value')} END AS score, "
    "[round(value, 6), CASE WHEN event_type = 'view' THEN NULL ELSE 1.0::DOUBLE END] AS scores FROM events")


@query("raw_to_json")
def q_raw_to_json(spark, d):
    c = T_(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return IO.raw_to_json(c, ["c_custkey", "c_mktsegment"])


reg("raw_to_json", "SELECT c_custkey, c_mktsegment, CAST(to_json({'c_custkey': c_custkey, 'c_nationkey': c_nationkey, "
    "'c_mktsegment': c_mktsegment}) AS VARCHAR) AS raw_data FROM customer")


@query("json_to_table")
def q_json_to_table(spark, d):
    ev = T_(spark, d, "events")
    return IO.json_to_table(ev, "props", T.StructType([T.StructField("k", T.LongType())]), ["event_id"])


reg("json_to_table", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")

# fixed values: file-name patterns of the input roles (first match wins)
ROUTES = [("lineitem", "installments_payments"), ("orders", "previous_application"), ("customer", "application"),
          ("events", "prediction_log"), ("part", "feature_importance")]


@query("route_by_name")
def q_route(spark, d):
    return IO.route_by_name(IO.list_files(spark, f"{d}/*.parquet"), ROUTES)


# ---------------------------------------------------------------- operational tables (L)

def batch_table(spark, d):
    lg = prediction_log(T_(spark, d, "events"))
    b = batches(lg)
    times = lg.groupBy("batch_date").agg(F.min("ts").alias("created_at"), F.max("ts").alias("completed_at"))
    return b.join(times, "batch_date").select(
        F.col("batch_date").cast("string").alias("batch_id"), "created_at",
        (F.col("created_at") + F.expr("INTERVAL 1 SECOND")).alias("started_at"), "completed_at",
        F.col("status").alias("final_status"))


@query("batch_lifecycle")
def q_lifecycle(spark, d):
    return round_double_cols(O.latest_state(O.lifecycle_events(batch_table(spark, d))))


reg("batch_lifecycle", (
    "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS batch_id, CASE WHEN COUNT_IF(event_type = 'error') / COUNT(*) > 0.22e0 "
    f"THEN 'failed' ELSE 'completed' END AS status, {rnd_sql('(epoch_us(MAX(ts)) - epoch_us(MIN(ts))) / 1e6')} AS duration_seconds "
    "FROM events GROUP BY 1"))


@query("latest_metric")
def q_latest_metric(spark, d):
    return round_double_cols(O.latest_metric(T_(spark, d, "events"), "event_type", "value", "ts"))


reg("latest_metric", f"SELECT event_type, {rnd_sql('arg_max(value, (ts, value))')} AS latest_value, MAX(ts) AS recorded_at FROM events GROUP BY event_type")


@query("request_stats")
def q_request_stats(spark, d):
    ev = T_(spark, d, "events")
    return round_double_cols(O.request_stats(ev, "ts", "value", F.col("event_type") == "error"))


reg("request_stats", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, COUNT(*) AS n_requests, "
    + ", ".join(f"{rnd_sql(e)} AS {n}" for n, e in [("error_rate", "AVG(CAST(event_type = 'error' AS DOUBLE))"),
                                                    ("p50_ms", "quantile_cont(value, 0.5)"), ("p95_ms", "quantile_cont(value, 0.95)"),
                                                    ("p99_ms", "quantile_cont(value, 0.99)")]) + " FROM events GROUP BY 1")


@query("retention")
def q_retention(spark, d):
    return round_double_cols(O.retention(T_(spark, d, "orders"), "o_orderdate", 180).select("o_orderkey", "o_orderdate", "o_totalprice"))


reg("retention", f"SELECT o_orderkey, o_orderdate, {rnd_sql('o_totalprice')} AS o_totalprice FROM orders "
    "WHERE o_orderdate > (SELECT MAX(o_orderdate) FROM orders) - INTERVAL 180 DAY")


@query("batch_export")
def q_batch_export(spark, d):
    lg = prediction_log(T_(spark, d, "events"))
    last = lg.agg(F.max("batch_date").alias("__b"))
    return round_double_cols(lg.join(last, lg.batch_date == last["__b"], "left_semi").orderBy("ts", "event_id").select(
        "event_id", "user_id", "probability", "risk_level"))


reg("batch_export", (f"SELECT event_id, user_id, {rnd_sql('LEAST(value / 500e0, 1e0)')} AS probability, CASE WHEN LEAST(value / 500e0, 1e0) < 0.3e0 "
                     "THEN 'LOW' WHEN LEAST(value / 500e0, 1e0) < 0.5e0 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level FROM events "
                     "WHERE CAST(ts AS DATE) = (SELECT MAX(CAST(ts AS DATE)) FROM events) ORDER BY ts, event_id"))


@query("append_partitioned")
def q_append_partitioned(spark, d):
    """Batch predictions stored batch by batch in a Parquet table
    partitioned by batch date, the second part twice (a rerun), then read back."""
    lg = prediction_log(T_(spark, d, "events")).select("event_id", "batch_date", "probability", "risk_level")
    path = IO.scratch_path(spark, "predictions")
    split = F.lit("2024-01-16").cast("date")
    for part in (F.col("batch_date") < split, F.col("batch_date") >= split, F.col("batch_date") >= split):
        write_batch(lg.where(part), path, "batch_date")
    back = read_batches(spark, path, "batch_date")
    return back.groupBy(F.col("batch_date").cast("string").alias("batch_date")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("retention_purge")
def q_retention_purge(spark, d):
    """L4: orders stored by month, the months that ended 180 days before the newest
    order purged from the table; what is left per month."""
    o = T_(spark, d, "orders").select("o_orderkey", "o_orderdate", F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    path = IO.scratch_path(spark, "orders-by-month")
    write_batch(o, path, "month")
    newest = o.agg(F.date_format(F.date_sub(F.max("o_orderdate"), 180), "yyyy-MM")).first()[0] or ""
    purge(spark, path, "month", F.col("month") < newest)
    return read_batches(spark, path, "month").groupBy("month").agg(F.count(F.lit(1)).alias("n_rows"), F.max("o_orderkey").alias("last_key"))


reg("retention_purge", "SELECT strftime(o_orderdate, '%Y-%m') AS month, COUNT(*) AS n_rows, MAX(o_orderkey) AS last_key FROM orders "
    "WHERE strftime(o_orderdate, '%Y-%m') >= (SELECT strftime(CAST(MAX(o_orderdate) AS DATE) - 180, '%Y-%m') FROM orders) GROUP BY 1")


reg("append_partitioned", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS batch_date, COUNT(*) AS n_rows FROM events GROUP BY 1")
