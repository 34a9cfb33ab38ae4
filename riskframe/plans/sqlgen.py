"""Small helpers that spell the same definitions as oracle SQL text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SQL_STATS = {
    "count": "COUNT({c})",
    "size": "COUNT(*)",
    "sum": "COALESCE(SUM({c}), 0)",
    "mean": "AVG({c})",
    "min": "MIN({c})",
    "max": "MAX({c})",
    "std": "STDDEV_SAMP({c})",
    "var": "VAR_SAMP({c})",
    "median": "MEDIAN({c}::DOUBLE)",
    "nunique": "COUNT(DISTINCT {c})",
}


# Results are compared across engines whose float sums differ in the last
# bits.  Rounding to a binary grid (2^-20 ~ 1e-6) instead of a decimal one
# keeps exact decimal ties such as 12.3456785 (means of cents) away from the
# rounding boundary; both spellings below give bit-identical results.
GRID = {6: 1048576.0, 4: 16384.0, 2: 128.0}


def rnd_sql(expr: str, d: int = 6) -> str:
    """Deterministic rounding to the 2^-20 grid, spelled identically to ``rnd``."""
    g = GRID[d]
    return f"(round_even(({expr}) * {g:.1f}e0, 0) / {g:.1f}e0 + 0e0)"


def rnd(c, d: int = 6) -> Column:
    """rint(x * 2^20) / 2^20, doubles all the way (no range limit) -- bit-identical
    to ``rnd_sql`` for equal x; adding 0 turns -0 into 0."""
    c = F.col(c) if isinstance(c, str) else c
    g = GRID[d]
    return F.rint(c.cast("double") * F.lit(g)) / F.lit(g) + F.lit(0.0)


def sql_agg(spec: Mapping[str, Sequence[str]], prefix: str, int_cols: Sequence[str] = (),
            round_doubles: int | None = 6) -> list[str]:
    out = []
    for c, stats in spec.items():
        for s in stats:
            e = SQL_STATS[s].format(c=c)
            name = f"{prefix}_{c}_{s.upper()}"
            if s in ("count", "size", "nunique"):
                out.append(f"CAST({e} AS BIGINT) AS {name}")
            elif s == "sum" and c in int_cols:
                out.append(f"CAST({e} AS BIGINT) AS {name}")
            elif s in ("min", "max") and c in int_cols:
                out.append(f"CAST({e} AS BIGINT) AS {name}")
            elif round_doubles is not None:
                out.append(f"{rnd_sql(e, round_doubles)} AS {name}")
            else:
                out.append(f"{e} AS {name}")
    return out


def round_double_cols(df, d: int = 6, exclude: Sequence[str] = ()):
    """Apply ``rnd`` to every double column (one ``selectExpr``: a single
    analyzer pass however wide the table)."""
    from pyspark.sql import types as T
    g = GRID[d]
    exprs = []
    for f in df.schema.fields:
        q = "`" + f.name.replace("`", "``") + "`"
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name not in exclude:
            exprs.append(f"rint(CAST({q} AS DOUBLE) * {g:.1f}D) / {g:.1f}D + 0.0D AS {q}")
        else:
            exprs.append(q)
    return df.selectExpr(*exprs)
