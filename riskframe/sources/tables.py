"""Table scans: Parquet first, CSV fallback, NaN normalised to NULL.

pandas treats NaN as "missing" and skips it in every aggregate; Spark treats
NaN as an ordinary (largest) double.  Every floating column is therefore
mapped NaN -> NULL right at the scan so downstream aggregates agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

FLOATING = (T.DoubleType, T.FloatType)


def _nan_to_null(c: Column) -> Column:
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def nan_to_null_all(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every floating column (other columns untouched);
    one ``selectExpr`` so wide tables cost one analyzer pass."""
    exprs, changed = [], False
    for f in df.schema.fields:
        q = "`" + f.name.replace("`", "``") + "`"
        if isinstance(f.dataType, FLOATING):
            exprs.append(f"CAST(CASE WHEN isnan({q}) THEN NULL ELSE {q} END AS {f.dataType.simpleString()}) AS {q}")
            changed = True
        else:
            exprs.append(q)
    return df.selectExpr(*exprs) if changed else df


def read_table(spark: SparkSession, base: str, name: str, *, schema: T.StructType | None = None,
               normalize_nan: bool = True) -> DataFrame:
    """Read ``base/name.parquet``; fall back to ``base/name.csv`` with a header.

    Column pruning and filters still reach the Parquet scan: the NaN
    normalisation is a projection Catalyst prunes to the columns used.
    """
    pq = f"{base.rstrip('/')}/{name}.parquet"
    csv = f"{base.rstrip('/')}/{name}.csv"
    try:
        df = spark.read.parquet(pq)
    except AnalysisException:
        r = spark.read.option("header", True).option("nanValue", "NaN")
        df = (r.schema(schema) if schema is not None else r.option("inferSchema", True)).csv(csv)
    return nan_to_null_all(df) if normalize_nan else df


def read_tables(spark: SparkSession, base: str, names) -> dict[str, DataFrame]:
    return {n: read_table(spark, base, n) for n in names}
