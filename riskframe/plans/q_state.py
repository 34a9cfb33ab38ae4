"""Stored sketches (E7, E10, H6) and documents of unknown keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.operators.sketches import batch_sketches, merged
from riskframe.plans.registry import query
from riskframe.sources import io as IO
from riskframe.sources.batches import read_batches, write_batch
from riskframe.sources.documents import documents_to_table

ORACLE: dict[str, str] = {}
PROBS = (0.25, 0.5, 0.95)
#: Accepted errors of the query's flags: share of the distinct count, share of the rows.
DISTINCT_ERROR, RANK_ERROR = 0.03, 0.01


@query("sketch_rollup")
def q_sketch_rollup(spark, d):
    """Daily sketches per event type, written by day (twice: a replay changes nothing), merged over all days;
    the estimates are held against the exact counts and ranks of the same rows."""
    ev = spark.read.parquet(f"{d}/events.parquet").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type", "event_id", "user_id", "value")
    path = IO.scratch_path(spark, "event-sketches")
    daily = batch_sketches(ev, ["day", "event_type"], ["event_id", "user_id"], ["value"])
    for _ in range(2):
        write_batch(daily, path, "day")
    m = IO.materialize(merged(read_batches(spark, path, "day"), ["event_type"], ["event_id", "user_id"], ["value"], PROBS), "merged-sketches")
    est = m.select(F.col("event_type").alias("t"), F.col("n_rows").alias("stored_rows"), "distinct_event_id", "distinct_user_id", "q_value")
    exact = ev.join(est.select("t", "q_value"), F.col("event_type").eqNullSafe(F.col("t"))).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("value").alias("n"), F.countDistinct("event_id").alias("events"), F.countDistinct("user_id").alias("users"),
        *[F.count(F.when(F.col("value") < F.col("q_value")[i], 1)).alias(f"under_{i}") for i in range(len(PROBS))],
        *[F.count(F.when(F.col("value") <= F.col("q_value")[i], 1)).alias(f"upto_{i}") for i in range(len(PROBS))])
    j = exact.join(est, F.col("event_type").eqNullSafe(F.col("t")))
    near = [(F.abs(F.col(e) - F.col(x)) <= F.col(x) * DISTINCT_ERROR).alias(f"{x}_ok") for e, x in (("distinct_event_id", "events"), ("distinct_user_id", "users"))]
    rank = [((F.col(f"under_{i}") <= (p + RANK_ERROR) * F.col("n")) & (F.col(f"upto_{i}") >= (p - RANK_ERROR) * F.col("n"))).alias(f"p{round(p * 100)}_ok")
            for i, p in enumerate(PROBS)]
    return j.select("event_type", "stored_rows", "events", "users", *near, *rank)


ORACLE["sketch_rollup"] = ("SELECT event_type, COUNT(*) AS stored_rows, COUNT(DISTINCT event_id) AS events, COUNT(DISTINCT user_id) AS users, TRUE AS events_ok, "
                           "TRUE AS users_ok, TRUE AS p25_ok, TRUE AS p50_ok, TRUE AS p95_ok FROM events GROUP BY event_type")


@query("documents_to_table")
def q_documents_to_table(spark, d):
    """Documents whose keys differ by event type: absent, of two types, nested, cut off."""
    ev = spark.read.parquet(f"{d}/events.parquet")
    whole = F.to_json(F.struct(
        F.col("user_id").alias("user"), F.when(F.col("event_type") != "click", F.col("event_id")).alias("seen"),
        F.when(F.col("event_type") == "signup", F.struct("event_type", "user_id")).alias("origin"), F.col("event_id").alias("EVENT_ID")))
    note = F.when(F.col("event_type") == "error", F.col("user_id").cast("string")).otherwise(F.concat(F.lit('"'), F.col("event_type"), F.lit('"')))
    doc = F.concat(F.lit('{"the note": '), note, F.lit(', "half": '), (F.col("user_id") / 2).cast("decimal(18,1)").cast("string"), F.lit(", "), F.substring(whole, 2, 1 << 20))
    doc = F.when(F.col("event_type") == "view", F.substring(doc, 1, 12)).otherwise(doc)
    return documents_to_table(ev.select("event_id", doc.alias("doc")), "doc", ["event_id"])


ORACLE["documents_to_table"] = """
SELECT event_id, CASE WHEN ok THEN event_id END AS "doc_EVENT_ID", CASE WHEN ok THEN user_id / 2.0::DOUBLE END AS half,
       CASE WHEN ok AND event_type = 'signup' THEN '{"event_type":"signup","user_id":' || user_id || '}' END AS origin,
       CASE WHEN ok AND event_type <> 'click' THEN event_id END AS seen,
       CASE WHEN ok THEN CASE WHEN event_type = 'error' THEN user_id::VARCHAR ELSE event_type END END AS "the note", CASE WHEN ok THEN user_id END AS "user"
FROM (SELECT *, event_type <> 'view' AS ok FROM events)"""
