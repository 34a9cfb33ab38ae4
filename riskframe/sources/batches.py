"""Batch tables: idempotent writes, commit records, purge.

A batch is one partition of a Parquet table.  ``write_batch`` replaces exactly the
partitions it holds (dynamic partition overwrite: files are staged and moved when
the job commits), so writing a batch again leaves the table as it is, and a write that
fails leaves nothing.  A commit record, written after the data, names the batch with
its rows; ``read_batches`` shows committed batches only.  ``purge`` takes the record
away before the files, so a purge that stops half-way is finished by the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMMITS = "_commits"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def write_batch(df: DataFrame, path: str, batch: str) -> None:
    """Write the batches that ``df`` holds (values of its column ``batch``, cast to string;
    null is refused), each replacing what the table had of it."""
    spark = df.sparkSession
    col = F.col(f"`{batch}`").cast("string")
    d = df.withColumn(batch, F.when(col.isNull(), F.raise_error(F.lit(f"{batch} is null"))).otherwise(col))
    d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(batch).parquet(path)
    written = spark.read.schema(d.schema).parquet(path)
    now = d.select(batch).distinct()
    rows = written.join(now, batch, "left_semi").groupBy(batch).agg(F.count(F.lit(1)).alias("n_rows"))
    rows.withColumn("committed_at", F.current_timestamp()).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(batch).parquet(f"{path}/{COMMITS}")


def commits(spark: SparkSession, path: str, batch: str) -> DataFrame:
    """(batch, n_rows, committed_at); empty where nothing was committed yet."""
    schema = f"n_rows long, committed_at timestamp, `{batch}` string"
    if not _exists(spark, f"{path}/{COMMITS}"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{COMMITS}")


def _table(spark: SparkSession, path: str, batch: str) -> DataFrame:
    """The files as they are, batch names as text (``007`` is not 7)."""
    found = spark.read.parquet(path).schema
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == batch else f.dataType) for f in found])
    return spark.read.schema(schema).parquet(path)


def read_batches(spark: SparkSession, path: str, batch: str) -> DataFrame:
    """Rows of committed batches."""
    return _table(spark, path, batch).join(commits(spark, path, batch).select(batch), batch, "left_semi")


def purge(spark: SparkSession, path: str, batch: str, expired: Column) -> DataFrame:
    """Delete the batches for which ``expired`` (an expression on ``batch``) holds.  Returns
    (batch, n_rows) of those; their number, not their rows, passes the driver."""
    gone = commits(spark, path, batch).where(expired).select(batch, "n_rows").collect()
    base = _table(spark, path, batch).select(batch).where(expired).distinct()
    names = sorted({r[batch] for r in gone} | {r[batch] for r in base.collect()})        # also what an interrupted purge left
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for folder in (f"{path}/{COMMITS}", path):
        for name in names:
            _delete(spark, f"{folder}/{batch}={escape(name)}")
    return spark.createDataFrame([(r[batch], r["n_rows"]) for r in gone], f"`{batch}` string, n_rows long")
