"""Structured Streaming versions of the log-monitoring operators.

Every job reads a table path (a file or a folder of files) as a file stream with
an explicit schema, keeps its state in the checkpoint location (so a restarted
driver or a lost executor resumes exactly once) and writes Parquet by epoch: a
replayed epoch overwrites its own folder and adds nothing.

Windowed aggregates run in update mode: state behind the watermark is dropped,
an epoch writes only the windows it changed, and readers take each window's
newest epoch.  (Append mode would hold back the windows that are still open when
a drained stream ends.)  ``run_available`` drains what is there with
``trigger(availableNow=True)``; on a cluster the same job runs with a
processing-time trigger.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.functions.exprs import risk_band
from riskframe.sources.io import materialize, scratch_path

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def events_stream(spark: SparkSession, sf_dir: str, name: str = "events", max_files: int | None = None) -> DataFrame:
    """The table ``name`` as a stream; ``max_files`` bounds the files of one micro-batch."""
    r = spark.readStream.schema(EVENTS_SCHEMA)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    # a pattern for the one path: the file source takes a folder or a single file that way
    return r.parquet(f"{sf_dir.rstrip('/')}/{name}.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def write_epoch(batch: DataFrame, epoch: int, out: str) -> None:
    """One folder per epoch: a replay overwrites it."""
    batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")


def run_available(df: DataFrame, name: str, mode: str = "append",
                  batch_fn: Callable[[DataFrame, int, str], None] = write_epoch, ckpt: str | None = None, out: str | None = None) -> str:
    """Drain the stream into a folder under the shared checkpoint dir (column
    ``epoch`` names the micro-batch); return the folder."""
    spark = df.sparkSession
    out, ckpt = out or scratch_path(spark, f"stream-{name}"), ckpt or scratch_path(spark, f"stream-{name}-ckpt")
    q = (df.writeStream.outputMode(mode).option("checkpointLocation", ckpt).trigger(availableNow=True)
         .foreachBatch(lambda b, epoch: batch_fn(b, epoch, out)).start())
    q.awaitTermination()
    return out


def newest(spark: SparkSession, out: str, key: str | Sequence[str]) -> DataFrame:
    """The newest epoch's row of each key (one key's updates: an aggregate)."""
    key = [key] if isinstance(key, str) else list(key)
    t = spark.read.parquet(out)
    rest = [c for c in t.columns if c not in key and c != "epoch"]
    return t.groupBy(*key).agg(F.max_by(F.struct(*rest), "epoch").alias("__r")).select(*key, "__r.*")


def prediction_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    ev = events_stream(spark, sf_dir, max_files=max_files)
    p = F.least(F.col("value") / F.lit(500.0), F.lit(1.0))
    return ev.withColumn("probability", p).withColumn("risk_level", risk_band(p))


def tumbling(spark: SparkSession, sf_dir: str, size: str = "1 day", watermark: str = "60 days", max_files: int | None = None) -> DataFrame:
    s = prediction_stream(spark, sf_dir, max_files).withWatermark("ts", watermark)
    agg = s.groupBy(F.window("ts", size).alias("w")).agg(
        F.count(F.lit(1)).alias("n_predictions"), F.avg("probability").alias("avg_probability"),
        *[F.count_if(F.col("risk_level") == b).alias(f"n_{b.lower()}") for b in ("LOW", "MEDIUM", "HIGH")])
    out = run_available(agg, "tumbling", "update")
    return newest(spark, out, "w").select(F.col("w.start").cast("string").alias("window_start"), "n_predictions",
                                          "avg_probability", "n_low", "n_medium", "n_high")


def sliding(spark: SparkSession, sf_dir: str, size: str = "7 days", slide: str = "1 day", watermark: str = "60 days",
            max_files: int | None = None) -> DataFrame:
    s = prediction_stream(spark, sf_dir, max_files).withWatermark("ts", watermark)
    agg = s.groupBy(F.window("ts", size, slide).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("event_type") == "error").cast("double")).alias("default_rate"))
    out = run_available(agg, "sliding", "update")
    return newest(spark, out, "w").select(F.col("w.start").cast("string").alias("window_start"), "n", "default_rate")


def error_alerts(spark: SparkSession, sf_dir: str, size: str = "1 hour", max_rate: float = 0.05, watermark: str = "60 days",
                 max_files: int | None = None) -> DataFrame:
    s = prediction_stream(spark, sf_dir, max_files).withWatermark("ts", watermark)
    agg = s.groupBy(F.window("ts", size).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("event_type") == "error").cast("double")).alias("error_rate"))
    out = run_available(agg, "alerts", "update")
    return newest(spark, out, "w").where(F.col("error_rate") > max_rate).select(
        F.col("w.start").cast("string").alias("window_start"), "n", "error_rate")


def dedup(spark: SparkSession, sf_dir: str, watermark: str = "60 days", max_files: int | None = None) -> DataFrame:
    """The event stream arrives twice (replayed table); duplicates by event_id
    are dropped.  The watermark must span the disorder of the arrivals: rows
    that are later than it are dropped with the duplicates."""
    a = events_stream(spark, sf_dir, max_files=max_files)
    b = events_stream(spark, sf_dir, max_files=max_files)
    u = a.unionByName(b).withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"])
    out = run_available(u, "dedup")
    return spark.read.parquet(out).groupBy("event_type").agg(F.count(F.lit(1)).alias("n_events"))


def ingest_epoch(batch: DataFrame, epoch: int, out: str) -> None:
    """Good lines and quarantined lines of one epoch, from one evaluation."""
    batch.persist()
    try:
        write_epoch(batch.where(F.col("j.event_type").isNotNull()).select("j.*"), epoch, f"{out}/good")
        write_epoch(batch.where(F.col("j.event_type").isNull()).select("value"), epoch, f"{out}/quarantine")
    finally:
        batch.unpersist()


def ingest(spark: SparkSession, log_dir: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """JSON-lines stream: good lines -> table, unparsable lines -> quarantine."""
    raw = spark.readStream.format("text").load(log_dir)
    parsed = raw.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("j"), "value")
    out = run_available(parsed, "ingest", "append", ingest_epoch)
    return spark.read.parquet(f"{out}/good").drop("epoch"), spark.read.parquet(f"{out}/quarantine").drop("epoch")


def incremental_psi(spark: SparkSession, sf_dir: str, edges: DataFrame, feature: str = "value", max_files: int | None = None) -> DataFrame:
    """Bin counts of the streamed current period against fixed reference edges
    (written once, so that no micro-batch fits them again)."""
    s = events_stream(spark, sf_dir, max_files=max_files).where(F.col("ts") >= F.lit("2024-01-16 00:00:00").cast("timestamp")) \
        .withColumn(feature, F.col(feature) * F.lit(1.2))
    e = F.broadcast(materialize(edges, "stream-edges"))   # one row: the reference's inner edges (bounded by the bin count)
    binned = s.crossJoin(e).select(F.size(F.filter("inner", lambda x: x <= F.col(feature))).alias("bin"))
    # a micro-batch writes its own counts; there are at most as many bins as edges
    out = run_available(binned, "psi-bins", "append", lambda b, epoch, o: write_epoch(b.groupBy("bin").agg(F.count(F.lit(1)).alias("c")), epoch, o))
    return spark.read.parquet(out).groupBy("bin").agg(F.sum("c").alias("c"))


def stream_static_score(spark: SparkSession, sf_dir: str, state: DataFrame, max_files: int | None = None) -> DataFrame:
    """Stream x static fitted state (one row per category, written once): scored
    rows appended.  No broadcast hint: the state's size is a category count,
    so the planner decides from its statistics."""
    s = prediction_stream(spark, sf_dir, max_files)
    j = s.join(materialize(state, "stream-state"), "event_type", "left").select(
        "event_id", "event_type", "value", (F.col("value") / (F.col("type_mean") + F.lit(1e-5))).alias("value_vs_type_mean"))
    out = run_available(j, "score")
    return spark.read.parquet(out).drop("epoch")


def late_data(spark: SparkSession, sf_dir: str, cuts: Sequence[str] = ("2024-01-23 00:00:00", "2024-01-16 00:00:00"),
              watermark: str = "1 day") -> tuple[DataFrame, DataFrame]:
    """Arrivals from newest to oldest, each drained before the next comes: what
    lies behind the watermark by then is dropped by the window aggregation
    (append mode: a window is emitted once, when the watermark has passed it).
    Returns (emitted windows, the input table)."""
    src, ckpt, out = scratch_path(spark, "late-src"), scratch_path(spark, "late-ckpt"), scratch_path(spark, "late-out")
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = [F.lit(c).cast("timestamp_ntz") for c in cuts]
    parts = [F.col("ts") >= at[0], *[(F.col("ts") >= lo) & (F.col("ts") < hi) for hi, lo in zip(at, at[1:])], F.col("ts") < at[-1]]
    for i, cond in enumerate(parts):
        ev.where(cond).write.parquet(f"{src}/arrival{i}")
        s = (spark.readStream.schema(EVENTS_SCHEMA).option("recursiveFileLookup", True).parquet(src)
             .withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark))
        run_available(s.groupBy(F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n")), "late", "append", ckpt=ckpt, out=out)
    return spark.read.parquet(out), ev
