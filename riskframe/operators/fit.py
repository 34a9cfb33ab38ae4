"""Fit / transform with explicit, persisted state.

``fit_*`` returns small state (one value per column, or a vocabulary of at
most ``max_categories`` values per column) computed by ONE aggregate; the
``transform`` side is pure column expressions, so scoring is a map-only job.
State round-trips through Parquet with ``save_state`` / ``load_state``.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.operators.checks import is_numeric


def fit_one_hot(df: DataFrame, cols: Sequence[str], max_categories: int = 10) -> dict[str, list]:
    """Sorted vocabularies of the columns with fewer than ``max_categories``
    distinct values; higher-cardinality columns get no entry (dropped)."""
    nd = df.agg(*[F.countDistinct(c).alias(c) for c in cols]).first()
    low = [c for c in cols if nd[c] < max_categories]
    if not low:
        return {}
    sets = df.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in low]).first()   # < max_categories each
    return {c: list(sets[c]) for c in low}


def one_hot(df: DataFrame, vocab: Mapping[str, Sequence], cols: Sequence[str], drop_first: bool = True) -> DataFrame:
    """0/1 columns ``{col}_{value}`` from a stored vocabulary; the smallest
    category is dropped; NULL and unseen values give all zeros; columns
    without a vocabulary (high cardinality) are dropped."""
    new = {}
    for c, values in vocab.items():
        for v in (values[1:] if drop_first else values):
            new[f"{c}_{v}"] = F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0))
    return df.withColumns(new).drop(*cols)


#: State of a column whose missing rows are dropped.
DROP = "__drop_rows__"


def fit_impute(df: DataFrame, strategies: Mapping[str, str | tuple]) -> dict:
    """strategy per column: 'median' | 'mean' | 'mode' | ('constant', v) | 'drop'
    (rows without a value go)."""
    med = fit_medians(df, [c for c, s in strategies.items() if s == "median"])
    means = [c for c, s in strategies.items() if s == "mean"]
    row = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in means]).first() if means else None
    state = {}
    for c, s in strategies.items():
        if isinstance(s, tuple):
            state[c] = s[1]
        elif s == "median":
            state[c] = med[c]
        elif s == "mean":
            state[c] = row[c]
        elif s == "mode":
            state[c] = fit_mode(df, c)
        elif s == "drop":
            state[c] = DROP
        else:
            raise ValueError(f"unknown strategy {s!r} for {c}")
    return state


def fit_mode(df: DataFrame, c: str):
    """Most frequent non-null value, smallest on ties (counts per value first,
    so no task holds more than one value's count)."""
    vc = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("__n"))
    top = vc.agg(F.max("__n").alias("__m"))
    r = vc.join(top, vc["__n"] == top["__m"]).agg(F.min(c).alias("mode")).first()
    return r["mode"]


def impute(df: DataFrame, state: Mapping[str, object], indicator: bool = True) -> DataFrame:
    new = {}
    df = df.dropna(subset=[c for c, v in state.items() if v == DROP] or None) if DROP in state.values() else df
    for c, v in state.items():
        if v == DROP:
            continue
        if indicator:
            new[f"{c}_WAS_MISSING"] = F.col(c).isNull().cast("int")
        new[c] = F.coalesce(F.col(c), F.lit(v)) if v is not None else F.col(c)
    return df.withColumns(new)


def fit_medians(df: DataFrame, cols: Sequence[str] | None = None) -> dict:
    """Exact median per column (distributed quantiles; one value per column
    reaches the driver; all-missing columns map to None)."""
    from riskframe.operators.ordered import column_quantiles
    cols = list(cols or [c for c in df.columns if is_numeric(df, c)])
    got = {r.feature: r.quantile for r in column_quantiles(df, cols, [0.5]).collect()}
    return {c: got.get(c) for c in cols}


def impute_median(df: DataFrame, cols: Sequence[str], train_medians: Mapping[str, float]) -> DataFrame:
    """Stored training median, else this batch's median, else 0."""
    missing = [c for c in cols if train_medians.get(c) is None]
    batch = fit_medians(df, missing) if missing else {}
    fill = {c: (train_medians.get(c) if train_medians.get(c) is not None else
                (batch.get(c) if batch.get(c) is not None else 0.0)) for c in cols}
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float(fill[c]))) for c in cols})


def fit_scaler(df: DataFrame, cols: Sequence[str]) -> dict:
    """Mean and population std per column (std 0 -> 1, like StandardScaler)."""
    row = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m_{c}") for c in cols],
                 *[F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}") for c in cols]).first()
    return {c: (row[f"m_{c}"], (row[f"s_{c}"] if row[f"s_{c}"] not in (None, 0.0) else 1.0)) for c in cols}


def standardize(df: DataFrame, state: Mapping[str, tuple]) -> DataFrame:
    return df.withColumns({c: (F.col(c).cast("double") - F.lit(m)) / F.lit(s) for c, (m, s) in state.items()})


def recover_scaler(raw: DataFrame, scaled: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Per feature linear fit raw ~ scaled: slope = std, intercept = mean."""
    j = raw.select(key, *[F.col(c).alias(f"r_{c}") for c in cols]).join(
        scaled.select(key, *[F.col(c).alias(f"s_{c}") for c in cols]), key)
    wide = j.agg(*[F.regr_slope(f"r_{c}", f"s_{c}").alias(f"b_{c}") for c in cols],
                 *[F.regr_intercept(f"r_{c}", f"s_{c}").alias(f"a_{c}") for c in cols])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"b_{c}").alias("scale"),
                                                    F.col(f"a_{c}").alias("mean")) for c in cols])).alias("s")).select("s.*")


def variance_filter(df: DataFrame, cols: Sequence[str], threshold: float = 0.01) -> DataFrame:
    wide = df.agg(*[F.var_pop(F.col(c).cast("double")).alias(c) for c in cols])
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("variance"))
                                           for c in cols])).alias("s")).select("s.*")
    return long.withColumn("keep", F.coalesce(F.col("variance") > F.lit(threshold), F.lit(False)))


def corr_filter(df: DataFrame, cols: Sequence[str], threshold: float = 0.95) -> DataFrame:
    """Drop column j when ANY earlier column i<j has |r| > threshold (not greedy)."""
    from riskframe.operators.profile import corr_matrix
    cm = corr_matrix(df, cols)
    order = {c: i for i, c in enumerate(cols)}
    hit = cm.where(F.abs("corr") > F.lit(threshold)).groupBy("feature_b").agg(
        F.sort_array(F.collect_list("feature_a")).alias("correlated_with"))  # <= number of columns each
    feats = df.sparkSession.createDataFrame([(c, i) for c, i in order.items()], "feature string, pos int")
    return feats.join(hit, feats.feature == hit.feature_b, "left").select(
        "feature", F.col("correlated_with").isNotNull().alias("dropped"), "correlated_with")


def save_state(spark: SparkSession, state: dict, path: str) -> None:
    """Fitted state as a (key, json value) Parquet table."""
    rows = [(k, json.dumps(v)) for k, v in state.items()]
    spark.createDataFrame(rows, "key string, value string").coalesce(1).write.mode("overwrite").parquet(path)


def load_state(spark: SparkSession, path: str) -> dict:
    return {r.key: json.loads(r.value) for r in spark.read.parquet(path).collect()}
