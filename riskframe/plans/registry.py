"""Registry of bound queries: key -> Spark builder and its DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


@dataclass
class Bound:
    key: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    note: str = ""


REGISTRY: dict[str, Bound] = {}


def query(key: str, sql: str | None = None, note: str = ""):
    """Register a Spark builder under ``key`` with its oracle SQL (None = rows-only)."""
    def deco(fn):
        if key in REGISTRY:
            raise ValueError(f"duplicate query key {key}")

        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return normalize_types(fn(spark, sf_dir))
        build.__name__ = fn.__name__
        REGISTRY[key] = Bound(key, build, sql, note)
        return fn
    return deco


def normalize_types(df: DataFrame) -> DataFrame:
    """Integral -> bigint, float/decimal -> double: one numeric type per kind
    so result schemas compare equal across engines."""
    exprs, changed = [], False
    for f in df.schema.fields:
        t = f.dataType
        q = "`" + f.name.replace("`", "``") + "`"
        if isinstance(t, (T.IntegerType, T.ShortType, T.ByteType)):
            exprs.append(f"CAST({q} AS BIGINT) AS {q}"); changed = True
        elif isinstance(t, (T.FloatType, T.DecimalType)):
            exprs.append(f"CAST({q} AS DOUBLE) AS {q}"); changed = True
        else:
            exprs.append(q)
    return df.selectExpr(*exprs) if changed else df
