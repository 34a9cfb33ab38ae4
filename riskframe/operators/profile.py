"""Profiles and summaries (E13-E28): group-bys whose outputs are small."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.exprs import risk_band


def class_balance(df: DataFrame, label: str) -> DataFrame:
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    t = c.agg(F.sum("count").alias("__n"), F.max("count").alias("__mx"), F.min("count").alias("__mn"))
    return c.crossJoin(t).select(label, "count", (F.col("count") / F.col("__n")).alias("share"),
                                 (F.col("__mx") / F.col("__mn")).alias("imbalance_ratio"))


def crosstab_pct(df: DataFrame, row: str, col: str) -> DataFrame:
    g = df.groupBy(row, col).agg(F.count(F.lit(1)).alias("count"))
    t = g.groupBy(row).agg(F.sum("count").alias("__n"))
    return g.join(t, row).select(row, col, "count", (F.col("count") * F.lit(100.0) / F.col("__n")).alias("row_pct"))


def describe_by(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    from riskframe.operators.ordered import exact_quantiles
    v = F.col(value).cast("double")
    base = df.groupBy(*group).agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"),
        F.max(v).alias("max"))
    q = exact_quantiles(df, value, [0.25, 0.5, 0.75], group).groupBy(*group).agg(
        *[F.max(F.when(F.col("p_index") == i, F.col("quantile"))).alias(n) for i, n in enumerate(["p25", "p50", "p75"])])
    return base.join(q, list(group), "left")


def category_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per category column: distinct count, mode (smallest on ties), mode frequency."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value"))
                                         for c in cols])).alias("s")).select("s.*").where(F.col("value").isNotNull())
    vc = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    g = vc.groupBy("feature").agg(F.count(F.lit(1)).alias("n_unique"), F.max("n").alias("mode_freq"))
    mode = vc.join(g, "feature").where(F.col("n") == F.col("mode_freq")).groupBy("feature").agg(F.min("value").alias("mode"))
    return g.join(mode, "feature").select("feature", "n_unique", "mode", "mode_freq")


def pair_corr(x: Column, y: Column) -> Column:
    """Pearson r over pairwise-complete rows; NULL (not an error) when a side is constant."""
    both = x.isNotNull() & y.isNotNull()
    xx, yy = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.try_divide(F.covar_pop(xx, yy), F.stddev_pop(xx) * F.stddev_pop(yy))


def corr_target(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    wide = df.agg(*[pair_corr(F.col(c), F.col(target)).alias(c) for c in cols])
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("corr")) for c in cols])).alias("s")).select("s.*")
    return long.withColumn("abs_corr", F.abs("corr"))


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson r of every pair of columns, from a blocked Gram matrix (one pass, any width)."""
    from riskframe.operators.gram import correlations
    return correlations(df, cols)


# ---------------------------------------------------------------- prediction log / batches

def prediction_log(events: DataFrame) -> DataFrame:
    """Events as a scoring log: probability = min(value / 500, 1), band, batch = date."""
    p = F.least(F.col("value") / F.lit(500.0), F.lit(1.0))
    return events.select("event_id", "ts", "user_id", "event_type", "value", "props",
                         F.to_date("ts").alias("batch_date"), p.alias("probability"),
                         risk_band(p).alias("risk_level"))


def batches(log: DataFrame, max_error_share: float = 0.22) -> DataFrame:
    """One record per batch: counts, duration, status, average probability, band counts."""
    return log.groupBy("batch_date").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("event_type") == "error").alias("n_errors"),
        ((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / F.lit(1e6)).alias("processing_time_seconds"),
        F.avg("probability").alias("avg_probability"),
        *[F.count_if(F.col("risk_level") == b).alias(f"n_{b.lower()}") for b in ("LOW", "MEDIUM", "HIGH")]
    ).withColumn("status", F.when(F.col("n_errors") / F.col("total") > F.lit(max_error_share), "failed").otherwise("completed"))


def after_newest(df: DataFrame, col: str, cut) -> DataFrame:
    """Rows whose ``col`` is greater than ``cut(max of col)``.  The maximum is a
    scalar subquery, so the filter reaches the scan."""
    newest = df.select(F.col(col).alias("__v")).agg(F.max("__v").alias("__mx"))
    return df.where(F.col(col) > newest.select(cut(F.col("__mx"))).scalar())


def rolling_rates(log: DataFrame, days: int = 7) -> DataFrame:
    """Default (error) rate, average probability, high-risk share over the last N days of the log."""
    recent = after_newest(log, "ts", lambda mx: mx - F.expr(f"INTERVAL {days} DAYS"))
    return recent.agg(F.count(F.lit(1)).alias("n"),
                      F.avg((F.col("event_type") == "error").cast("double")).alias("default_rate"),
                      F.avg("probability").alias("avg_probability"),
                      (F.avg((F.col("risk_level") == "HIGH").cast("double")) * F.lit(100.0)).alias("high_risk_pct"))


def importance_table(df: DataFrame, feature: str, weight: str) -> DataFrame:
    return df.groupBy(F.col(feature).alias("feature")).agg(F.sum(weight).cast("double").alias("importance"))


def ranked_importance(imp: DataFrame) -> DataFrame:
    """Descending importance with cumulative share.  The window runs over the
    feature table (one row per feature: bounded by the model, not the data)."""
    w = Window.orderBy(F.col("importance").desc(), F.col("feature"))
    tot = imp.agg(F.sum("importance").alias("__t"))
    return imp.crossJoin(tot).withColumn("rank", F.row_number().over(w)).withColumn(
        "cumulative_importance", F.sum("importance").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.col("__t")).drop("__t")


def critical_features(imp: DataFrame, cum: float = 0.85, top: int = 50, larger: bool = True) -> DataFrame:
    r = ranked_importance(imp)
    n = r.agg(F.count_if(F.col("cumulative_importance") <= cum).alias("__nc"), F.count(F.lit(1)).alias("__n"))
    k = (F.greatest if larger else F.least)(F.col("__nc"), F.least(F.lit(top), F.col("__n")))
    return r.crossJoin(n).where(F.col("rank") <= k).select("feature", "importance", "rank", "cumulative_importance")


def raw_importance(imp: DataFrame, raw_of: Column, max_contrib: int = 5) -> DataFrame:
    """Sum derived-feature importance onto raw columns (many-to-many via an
    array of raw names); keep the top contributors as a sorted array."""
    e = imp.select("feature", "importance", F.explode(F.array_distinct(raw_of)).alias("raw_feature"))
    g = e.groupBy("raw_feature").agg(
        F.sum("importance").alias("importance"), F.count(F.lit(1)).alias("n_derived"),
        F.slice(F.sort_array(F.collect_list(F.struct((-F.col("importance")).alias("neg_imp"), F.col("feature")))), 1, max_contrib)
        .alias("__top"))
    return g.select("raw_feature", "importance", "n_derived", F.transform("__top", lambda s: s["feature"]).alias("top_contributors"))


# ---------------------------------------------------------------- feature provenance and labels

# fixed values: prefixes of aggregated feature families
AGG_PREFIXES = ("BUREAU_", "PREV_", "POS_", "CC_", "INST_")


def feature_source(name: Column, raw: Sequence[str]) -> Column:
    """RW raw input / PL polynomial / AG child-table aggregate / DM domain."""
    agg = None
    for p in AGG_PREFIXES:
        c = name.startswith(p)
        agg = c if agg is None else agg | c
    return (F.when(name.isin(*raw), "RW").when(name.startswith("POLY_"), "PL").when(agg, "AG").otherwise("DM"))


def feature_table(df: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """(feature, n_non_null) for every column: one aggregate, stacked."""
    cols = [c for c in df.columns if c not in key]
    wide = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in cols])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").alias("n_non_null"))
                                           for c in cols])).alias("s")).select("s.*")


def format_value(v: Column, is_integral: bool = False) -> Column:
    """NA for missing; integers with thousands separators; |x| >= 1000 -> no
    decimals, >= 1 -> 2 decimals, else 4 decimals."""
    if is_integral:
        return F.when(v.isNull(), "NA").otherwise(F.format_number(v, 0))
    a = F.abs(v)
    return (F.when(v.isNull(), "NA").when(a >= 1000, F.format_number(v, 0))
            .when(a >= 1, F.format_number(v, 2)).otherwise(F.format_number(v, 4)))


def format_label(name: Column, source: Column, missing: Column) -> Column:
    return F.concat(F.when(missing, F.lit("[M] ")).otherwise(F.lit("")), name, F.lit(" ("), source, F.lit(")"))
