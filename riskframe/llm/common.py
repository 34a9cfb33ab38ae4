"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.sources.io import materialize

#: A side table is broadcast only when its written rows and the bytes of its files are
#: at most these; beyond them the planner's shuffle join is used.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def save(df: DataFrame, name: str) -> DataFrame:
    """Written table in the shared checkpoint folder: lineage is cut, a lost
    executor re-reads files."""
    return materialize(df, name)


def written_bytes(written: DataFrame) -> int:
    """Bytes of the files of a WRITTEN table (one folder)."""
    files = written.inputFiles()
    if not files:
        return 0
    spark = written.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()


def broadcast_within(written: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a WRITTEN table for broadcast if its row count (read from the files'
    footers) and its files' bytes are within the bounds; otherwise leave it to the planner."""
    return F.broadcast(written) if written.count() <= max_rows and written_bytes(written) <= max_bytes else written


def parallelism(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session."""
    try:
        return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    except (TypeError, ValueError):
        return 200


#: Rows and bytes of an Arrow batch where whole texts go to Python workers.
TEXT_BATCH_ROWS, TEXT_BATCH_BYTES = 1_000, 1 << 20
#: Spark's defaults of the two.
DEFAULT_ROWS, DEFAULT_BYTES = "10000", "67108864b"


def text_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for the session's text operators, unless the user
    chose a size: a batch of Spark's default 10,000 rows of whole texts is tens
    of MB in the JVM and again in each Python worker, and the JVM's pool of Arrow
    buffers keeps what its largest batches took until the executor ends."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) in (None, DEFAULT_ROWS):
        spark.conf.set(key, str(TEXT_BATCH_ROWS))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in (None, DEFAULT_BYTES):
        spark.conf.set(key, str(TEXT_BATCH_BYTES))


def give_back() -> None:
    """Memory that this process has freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc only
    if trim:
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of Arrow batches whose worker gives freed memory back after its
    last batch: idle workers wait for later stages, and what their allocators
    keep counts beside the executor's heap all the while."""
    @functools.wraps(run)
    def inner(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()
    return inner


def spread_keys(spark: SparkSession, partitions: int, each: int = 1) -> list[int]:
    """``partitions * each`` integers, ``each`` of which a hash partitioning into
    ``partitions`` puts into every partition: groups named by them are dealt evenly
    (numbers from 0 on would meet in some partitions and leave others empty)."""
    n = partitions * each
    h = F.pmod(F.hash(F.col("id").cast("int")), F.lit(partitions))
    rows = (spark.range(0, 4 * n + 200 * partitions, 1, 1).select(F.col("id").cast("int").alias("id"), h.alias("p"))
            .groupBy("p").agg(F.slice(F.sort_array(F.collect_list("id")), 1, each).alias("ids")).collect())
    found = {r["p"]: r["ids"] for r in rows}
    spare = iter(range(4 * n + 200 * partitions, 2 ** 31))
    return [x for i in range(each) for p in range(partitions) for x in [found.get(p, [])[i] if i < len(found.get(p, [])) else next(spare)]]
