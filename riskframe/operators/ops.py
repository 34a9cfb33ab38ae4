"""Operational tables: batch lifecycle, metric logs, request statistics,
retention and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lifecycle_events(batches: DataFrame) -> DataFrame:
    """pending -> processing -> completed/failed status events per batch."""
    return batches.select("batch_id", F.explode(F.array(
        F.struct(F.lit("pending").alias("status"), F.col("created_at").alias("ts")),
        F.struct(F.lit("processing").alias("status"), F.col("started_at").alias("ts")),
        F.struct(F.col("final_status").alias("status"), F.col("completed_at").alias("ts")))).alias("e")).select("batch_id", "e.*")


def latest_state(events: DataFrame, key: str = "batch_id") -> DataFrame:
    """Latest status per batch (max timestamp; ties -> larger status) and the
    processing duration from first to last event."""
    return events.groupBy(key).agg(
        F.max(F.struct("ts", "status")).alias("__l"),
        (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).alias("__us")
    ).select(key, F.col("__l.status").alias("status"), (F.col("__us") / F.lit(1e6)).alias("duration_seconds"))


def latest_metric(log: DataFrame, metric: str, value: str, ts: str) -> DataFrame:
    return log.groupBy(metric).agg(F.max(F.struct(F.col(ts).alias("ts"), F.col(value).alias("v"))).alias("__l")) \
        .select(metric, F.col("__l.v").alias("latest_value"), F.col("__l.ts").alias("recorded_at"))


def request_stats(log: DataFrame, ts: str, latency: str, is_error, by_day: bool = True) -> DataFrame:
    """Volume, error rate and exact latency p50 / p95 / p99."""
    from riskframe.operators.ordered import exact_quantiles
    d = log.withColumn("day", F.to_date(ts).cast("string")) if by_day else log
    g = ["day"] if by_day else []
    base = d.groupBy(*g).agg(F.count(F.lit(1)).alias("n_requests"), F.avg(is_error.cast("double")).alias("error_rate"))
    q = exact_quantiles(d, latency, [0.5, 0.95, 0.99], g).groupBy(*g).agg(
        *[F.max(F.when(F.col("p_index") == i, F.col("quantile"))).alias(n) for i, n in enumerate(["p50_ms", "p95_ms", "p99_ms"])])
    return base.join(q, g, "left") if g else base.crossJoin(q)


def retention(df: DataFrame, ts: str, days: int = 180, as_of=None) -> DataFrame:
    """Rows newer than ``days`` before ``as_of`` (default: the newest row)."""
    if as_of is None:
        from riskframe.operators.profile import after_newest
        return after_newest(df, ts, lambda mx: mx - F.expr(f"INTERVAL {days} DAYS"))
    return df.where(F.col(ts) > F.lit(as_of) - F.expr(f"INTERVAL {days} DAYS"))
