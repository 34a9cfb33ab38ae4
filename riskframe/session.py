"""SparkSession factory with the settings every job here assumes."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "riskframe") -> SparkSession:
    """Return (or build) a session: UTC, ANSI on, AQE on, UI off.

    On a cluster the master and shuffle partitions come from the submit
    configuration; the arguments only matter for local runs and tests.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
        if master.startswith("local"):
            # local mode: the driver JVM is the only executor
            b = b.config("spark.driver.memory", os.environ.get("RISKFRAME_DRIVER_MEMORY", "16g"))
    b = (b.config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.ansi.enabled", "true")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.scheduler.mode", "FAIR")     # concurrent fits share the executors
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         # files of checkpoint() go when their data set is unreferenced; written
         # scratch tables go with riskframe.sources.io.release_scratch or at exit
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.  Where it is unset a scratch folder
    is made for local masters only (one machine: every task sees it); on a
    cluster it must be named, because executors do not share local folders."""
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    current = current.get() if current.isDefined() else None
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if current:
            return current
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that the driver and all executors share (master {master})")
        d = tempfile.mkdtemp(prefix="riskframe-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    if not current or d.rstrip("/") not in current:
        spark.sparkContext.setCheckpointDir(d)      # makes a folder of its own on every call: once only
    return d
