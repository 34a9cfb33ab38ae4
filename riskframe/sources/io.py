"""Sinks, format conversion, JSON documents and file routing.

Scratch output always goes under the cluster's shared checkpoint folder
(``spark.checkpoint.dir``), never a machine-local temp directory.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator, Sequence

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.functions.exprs import finite_or_null
from riskframe.session import ensure_checkpoint_dir


#: Scratch folders of this process that are not deleted yet: (path, Hadoop configuration).
_SCRATCH: list[tuple[str, object]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared checkpoint folder.  It is registered and
    deleted by ``release_scratch``, at the end of a ``scratch_scope`` or when
    the process exits, whichever comes first."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/riskframe-{name}-{uuid.uuid4().hex[:12]}"
    if not _SCRATCH:
        atexit.unregister(release_scratch)
        atexit.register(release_scratch)        # after the gateway's own hook, so it runs before it
    _SCRATCH.append((path, spark.sparkContext._jsc.hadoopConfiguration()))
    return path


def release_scratch(since: int = 0) -> None:
    """Delete the scratch folders registered after the first ``since``."""
    gone = _SCRATCH[since:]
    del _SCRATCH[since:]
    for path, conf in gone:
        with contextlib.suppress(Exception):        # the JVM may have ended already
            p = SparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def scratch_paths() -> list[str]:
    """Scratch folders that are not deleted yet, oldest first."""
    return [path for path, _ in _SCRATCH]


def release_paths(paths) -> None:
    """Delete some scratch folders now."""
    paths = set(paths)
    gone = [x for x in _SCRATCH if x[0] in paths]
    _SCRATCH[:] = [x for x in _SCRATCH if x[0] not in paths]
    for path, conf in gone:
        with contextlib.suppress(Exception):        # the JVM may have ended already
            p = SparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def release_tables(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more."""
    release_paths(t._scratch_path for t in tables if getattr(t, "_scratch_path", None))


@contextlib.contextmanager
def scratch_scope() -> Iterator[None]:
    """Scratch tables written inside are deleted at the end: consume results
    (collect, write) before leaving it."""
    since = len(_SCRATCH)
    try:
        yield
    finally:
        release_scratch(since)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared checkpoint folder and
    return the table: cuts lineage with one job and survives executor loss.
    The table's life ends with ``scratch_scope`` / ``release_scratch`` / the process."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.parquet(path)
    out._scratch_path = path
    return out


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> str:
    w = df.write.mode(mode).option("compression", "snappy")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).option("header", True).csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Typed CSV scan (no inference); 'NaN' cells become NULL doubles."""
    from riskframe.sources.tables import nan_to_null_all
    return nan_to_null_all(spark.read.option("header", True).option("nanValue", "NaN").schema(schema).csv(path))


def csv_to_parquet(spark: SparkSession, csv_path: str, schema: T.StructType, out: str) -> DataFrame:
    """Convert and verify: rows and columns before == after (one-row report)."""
    src = read_csv(spark, csv_path, schema)
    write_parquet(src, out)
    back = spark.read.parquet(out)
    a = src.agg(F.count(F.lit(1)).alias("rows_in"))
    b = back.agg(F.count(F.lit(1)).alias("rows_out"))
    return a.crossJoin(b).select("rows_in", "rows_out", F.lit(len(src.columns)).cast("bigint").alias("cols_in"),
                                 F.lit(len(back.columns)).cast("bigint").alias("cols_out"),
                                 ((F.col("rows_in") == F.col("rows_out")) & F.lit(len(src.columns) == len(back.columns))).alias("ok"))


def compact(spark: SparkSession, pattern: str, schema: T.StructType, out: str, rows_per_file: int = 5_000_000) -> DataFrame:
    """Merge many small CSV files matching a glob into Parquet files of at most
    ``rows_per_file`` rows; the number of writing tasks follows the input (the
    planner rebalances small partitions)."""
    df = read_csv(spark, pattern, schema)
    df.hint("rebalance").write.mode("overwrite").option("compression", "snappy").option("maxRecordsPerFile", rows_per_file).parquet(out)
    return spark.read.parquet(out)


def json_safe(c: Column, dtype: T.DataType) -> Column:
    """NaN / +-Inf -> NULL, recursively through arrays, maps and structs."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return finite_or_null(c)
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: json_safe(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(c, lambda k, v: json_safe(v, dtype.valueType))
    if isinstance(dtype, T.StructType):
        return F.struct(*[json_safe(c[f.name], f.dataType).alias(f.name) for f in dtype.fields])
    return c


def json_safe_df(df: DataFrame) -> DataFrame:
    return df.select(*[json_safe(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def raw_to_json(df: DataFrame, promoted: Sequence[str], doc: str = "raw_data") -> DataFrame:
    """Whole row as a JSON document plus typed promoted columns."""
    return df.select(*promoted, F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias(doc))


def json_to_table(df: DataFrame, doc: str, schema: T.StructType, keep: Sequence[str] = ()) -> DataFrame:
    parsed = F.from_json(F.col(doc), schema, {"mode": "PERMISSIVE"})
    return df.select(*keep, parsed.alias("__j")).select(*keep, "__j.*")


def read_jsonl_log(spark: SparkSession, path: str, schema: T.StructType, type_col: str = "event_type") -> DataFrame:
    """JSON-lines log: unparsable lines are dropped (quarantine them with
    ``_corrupt``), every good line keeps its ``event_type`` discriminator."""
    raw = spark.read.text(path)
    parsed = raw.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("j"), "value")
    return parsed.where(F.col(f"j.{type_col}").isNotNull()).select("j.*")


def list_files(spark: SparkSession, pattern: str) -> DataFrame:
    """File names and sizes of a glob (content column pruned, never read)."""
    return spark.read.format("binaryFile").load(pattern).select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"), "length")


def route_by_name(files: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Assign each file the role of the FIRST rule whose pattern its name contains."""
    role = F.lit(None).cast("string")
    for pattern, name in reversed(rules):
        role = F.when(F.col("file_name").contains(pattern), F.lit(name)).otherwise(role)
    return files.withColumn("role", role)
