"""Child-table rollups: many statistics over many columns in ONE groupBy.

Spark plans each rollup as HashAggregate(partial) -> Exchange(key) ->
HashAggregate(final), i.e. map-side combine before the shuffle, so a hot key
costs one partial row per map task rather than its whole row count.  Every
rollup groups by the parent key, so the parent joins that follow reuse that
hash partitioning (no second exchange on the aggregated side).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.exprs import safe_div

# statistics as SQL text: one py4j call per aggregate when building very wide
# rollups (hundreds of aggregates); a sum over all-missing is 0 like pandas
_STATS_SQL = {
    "count": "count({c})", "size": "count(1)", "sum": "coalesce(sum({c}), 0)", "mean": "avg({c})",
    "min": "min({c})", "max": "max({c})", "std": "stddev_samp({c})", "var": "var_samp({c})",
    "median": "median({c})", "nunique": "count(DISTINCT {c})",
}


def agg_exprs(spec: Mapping[str, Sequence[str]], prefix: str) -> list[Column]:
    """Aggregate expressions named ``PREFIX_COL_STAT`` (stat upper-cased)."""
    out = []
    for c, stats in spec.items():
        for s in ([stats] if isinstance(stats, str) else stats):
            if s not in _STATS_SQL:
                raise ValueError(f"unknown statistic {s!r}; use one of {sorted(_STATS_SQL)}")
            q = "`" + c.replace("`", "``") + "`"
            out.append(F.expr(f"{_STATS_SQL[s].format(c=q)} AS `{prefix}_{c}_{s.upper()}`"))
    return out


def pivot_count_exprs(column: str, values: Sequence[str], prefix: str,
                      template: str = "{prefix}_{value}_COUNT") -> list[Column]:
    """One ``count_if(column = v)`` per fitted category (missing -> 0)."""
    q = "`" + column.replace("`", "``") + "`"
    return [F.expr("count_if({} = '{}') AS `{}`".format(q, str(v).replace("'", "\\'"),
                                                        template.format(prefix=prefix, value=str(v).upper())))
            for v in values]


def fit_vocabulary(df: DataFrame, column: str, max_categories: int = 1000) -> list:
    """Sorted distinct non-null values of a category column.

    The result is driver-side state whose size is checked against
    ``max_categories``; it never grows with the row count.  A column with more
    categories is an error by contract: pass a vocabulary instead.
    """
    vals = (df.select(column).where(F.col(column).isNotNull()).distinct()
            .orderBy(column).limit(max_categories + 1).collect())
    if len(vals) > max_categories:
        raise ValueError(f"{column}: more than {max_categories} categories")
    return [r[0] for r in vals]


def agg_spec(df: DataFrame, key: str | Sequence[str], prefix: str,
             spec: Mapping[str, Sequence[str]], *, pivots: Mapping[str, Sequence] | None = None,
             extra: Sequence[Column] = (), drop_null_keys: bool = True) -> DataFrame:
    """Generic wide group-by.

    ``spec`` maps column -> statistics; ``pivots`` maps a category column to
    its fitted vocabulary (counts per value); ``extra`` are further named
    aggregate columns.  Everything lands in a single aggregate node.
    """
    keys = [key] if isinstance(key, str) else list(key)
    # medians go through the distributed exact-quantile path (a hot key's
    # values are never gathered in one task); every other statistic stays in
    # one aggregate node
    plain = {c: [s for s in ([st] if isinstance(st, str) else st) if s != "median"] for c, st in spec.items()}
    medians = [c for c, st in spec.items() if "median" in ([st] if isinstance(st, str) else st)]
    exprs = agg_exprs({c: st for c, st in plain.items() if st}, prefix)
    for c, vocab in (pivots or {}).items():
        exprs += pivot_count_exprs(c, vocab, f"{prefix}_{c}")
    exprs += list(extra)
    if drop_null_keys:  # pandas groupby drops missing keys
        cond = None
        for k in keys:
            cond = F.col(k).isNotNull() if cond is None else cond & F.col(k).isNotNull()
        df = df.where(cond)
    out = df.groupBy(*keys).agg(*exprs) if exprs else df.select(*keys).distinct()
    if medians:
        from riskframe.operators.ordered import exact_quantiles
        long = df.select(*keys, F.explode(F.array(*[
            F.struct(F.lit(c).alias("__feat"), F.col(c).cast("double").alias("__x")) for c in medians])).alias("__s")
        ).select(*keys, "__s.__feat", "__s.__x")
        med = exact_quantiles(long, "__x", [0.5], keys + ["__feat"]).groupBy(*keys).agg(*[
            F.max(F.when(F.col("__feat") == c, F.col("quantile"))).alias(f"{prefix}_{c}_MEDIAN") for c in medians])
        out = out.join(med, keys, "left")
        order = [f"{prefix}_{c}_{s.upper()}" for c, st in spec.items() for s in ([st] if isinstance(st, str) else st)]
        rest = [c for c in out.columns if c not in keys and c not in order]
        out = out.select(*keys, *order, *rest)
    return out


def with_ratio(df: DataFrame, name: str, num: str, den: str, plus: float = 1.0) -> DataFrame:
    return df.withColumn(name, safe_div(num, den, plus))
