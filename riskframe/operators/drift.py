"""Distribution tests and drift, computed for ALL features in one job.

Each side is unpivoted once into ONE table of counts per (feature, value) with
running and total counts; the KS gap, the reference deciles, the PSI bins, the
moments and the minimum counts all follow from it.  Partial aggregation happens
before the shuffle, so a feature holding most rows, or one hot value, stays cheap.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.operators.ordered import running_sum
from riskframe.sources.io import materialize

# fixed values: smoothing constants, bin count, alert level and interpretation labels
PSI_BINS = 10
PSI_EPS = 1e-6
CHI2_EPS = 1e-10
ALERT_P = 0.05
NUMERIC_LABELS = ("✅ No significant drift", "⚠️ Small drift (KS significant, low PSI)",
                  "⚠️ Moderate drift", "🔴 Significant drift (high PSI)")
CATEGORICAL_LABELS = ("✅ No significant drift", "⚠️ Small drift detected", "⚠️ Moderate drift detected",
                      "🔴 Significant drift detected")


def kolmogorov_p(d: Column, en: Column, terms: int = 100) -> Column:
    """Asymptotic two-sample KS p-value with Stephens' small-sample factor:
    Q(lambda) = 2 sum_j (-1)^(j-1) exp(-2 j^2 lambda^2)."""
    s = F.sqrt(en)
    lam = (s + F.lit(0.12) + F.try_divide(F.lit(0.11), s)) * d
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
                         lambda acc, j: acc + F.lit(2.0) * F.when(j % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
                         * F.exp(F.lit(-2.0) * j * j * lam * lam))
    return F.when(lam < F.lit(0.2), F.lit(1.0)).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))


def value_counts(reference: DataFrame, current: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, value, n_ref, n_cur) with running and total counts: one unpivot
    per side.  Text that is no number counts as missing (try_cast)."""
    def long(df, side):
        cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").try_cast("double").alias("value")) for c in cols])
        return df.select(F.inline(cells)).where(F.col("value").isNotNull() & ~F.isnan("value")).withColumn("ref", F.lit(side))
    both = long(reference, 1).unionByName(long(current, 0))
    counts = both.groupBy("feature", "value").agg(F.sum("ref").alias("n_ref"), F.sum(1 - F.col("ref")).alias("n_cur"))
    return materialize(running_sum(counts, "value", ["n_ref", "n_cur"], ["feature"], totals=True), "drift-counts")


def feature_stats(reference: DataFrame, current: DataFrame, cols: Sequence[str], n_bins: int = PSI_BINS) -> DataFrame:
    """One row per feature: n_ref, n_cur, D (largest gap), PSI, means and population
    standard deviations of both sides -- all from the count table: one
    aggregate for gaps, reference deciles and means, one for bins and squares."""
    c = value_counts(reference, current, cols)
    gap = F.abs(F.try_divide(F.col("cum_n_ref"), F.col("tot_n_ref")) - F.try_divide(F.col("cum_n_cur"), F.col("tot_n_cur")))
    probs = [i / n_bins for i in range(n_bins + 1)]
    last, first = F.col("cum_n_ref") - 1, F.col("cum_n_ref") - F.col("n_ref")

    def at(rank):       # the value that covers a reference rank
        return F.max(F.when((F.col("n_ref") > 0) & (rank >= first) & (rank <= last), F.col("value")))
    h = [(F.col("tot_n_ref") - 1).cast("double") * F.lit(p) for p in probs]
    one = c.groupBy("feature").agg(
        F.max("tot_n_ref").alias("n_ref"), F.max("tot_n_cur").alias("n_cur"), F.max(gap).alias("D"),
        F.try_divide(F.sum(F.col("value") * F.col("n_ref")), F.sum("n_ref")).alias("ref_mean"),
        F.try_divide(F.sum(F.col("value") * F.col("n_cur")), F.sum("n_cur")).alias("cur_mean"),
        *[at(F.floor(x)).alias(f"lo{i}") for i, x in enumerate(h)], *[at(F.ceil(x)).alias(f"hi{i}") for i, x in enumerate(h)])
    rank = lambda i: (F.col("n_ref") - 1).cast("double") * F.lit(probs[i])
    q = F.array_sort(F.array_distinct(F.array(*[F.col(f"lo{i}") + (rank(i) - F.floor(rank(i))) * (F.col(f"hi{i}") - F.col(f"lo{i}"))
                                                for i in range(len(probs))])))
    stats = materialize(one.withColumn("q", F.when(F.col("n_ref") > 0, q)).select("feature", "n_ref", "n_cur", "D", "ref_mean", "cur_mean", "q"), "drift-stats")
    # one row per feature with at most n_bins + 1 edges: bounded by the schema
    j = c.join(F.broadcast(stats.select("feature", "ref_mean", "cur_mean", "q")), "feature")
    inner = F.slice("q", 2, F.greatest(F.size("q") - 2, F.lit(0)))
    b = j.withColumn("bin", F.coalesce(F.size(F.filter(inner, lambda e: e <= F.col("value"))), F.lit(0)))
    dev = lambda m: (F.col("value") - F.col(m)) * (F.col("value") - F.col(m))
    two = b.groupBy("feature").agg(
        F.sum(dev("ref_mean") * F.col("n_ref")).alias("ref_sq"), F.sum(dev("cur_mean") * F.col("n_cur")).alias("cur_sq"),
        *[F.sum(F.when(F.col("bin") == i, F.col(n)).otherwise(0)).alias(f"{n}_{i}") for i in range(n_bins) for n in ("n_ref", "n_cur")])
    share = lambda n, i: (F.col(f"{n}_{i}") + F.lit(PSI_EPS)) / (F.col(n) + F.lit(PSI_EPS))
    psi_ = F.lit(0.0)
    for i in range(n_bins):
        term = (share("n_cur", i) - share("n_ref", i)) * F.log(share("n_cur", i) / share("n_ref", i))
        psi_ = psi_ + F.when(F.size("q") - 1 > i, term).otherwise(F.lit(0.0))
    feats = reference.sparkSession.createDataFrame([(c_,) for c_ in cols], "feature string")
    full = feats.join(stats, "feature", "left").join(two, "feature", "left")
    both = (F.coalesce("n_ref", F.lit(0)) > 0) & (F.coalesce("n_cur", F.lit(0)) > 0)
    return full.select(
        "feature", F.coalesce("n_ref", F.lit(0)).alias("n_ref"), F.coalesce("n_cur", F.lit(0)).alias("n_cur"), F.when(both, F.col("D")).alias("D"),
        F.when(both & (F.size("q") >= 2), psi_).otherwise(F.lit(0.0)).alias("psi"), "ref_mean", "cur_mean",
        F.sqrt(F.try_divide("ref_sq", "n_ref")).alias("ref_std"), F.sqrt(F.try_divide("cur_sq", "n_cur")).alias("cur_std"))


def _with_ks(stats: DataFrame) -> DataFrame:
    en = F.try_divide(F.col("n_ref") * F.col("n_cur"), F.col("n_ref") + F.col("n_cur"))
    return stats.withColumn("ks_statistic", F.coalesce("D", F.lit(0.0))).withColumn(
        "p_value", F.when(F.col("D").isNull(), F.lit(1.0)).otherwise(kolmogorov_p(F.col("D"), en)))


def ks_drift(reference: DataFrame, current: DataFrame, cols: Sequence[str], ranges: int | None = None) -> DataFrame:
    """Two-sample KS statistic D (exact) and p-value per feature."""
    c = value_counts(reference, current, cols)
    gap = F.abs(F.try_divide(F.col("cum_n_ref"), F.col("tot_n_ref")) - F.try_divide(F.col("cum_n_cur"), F.col("tot_n_cur")))
    ks = c.groupBy("feature").agg(F.max(gap).alias("D"), F.max("tot_n_ref").alias("n_ref"), F.max("tot_n_cur").alias("n_cur"))
    feats = reference.sparkSession.createDataFrame([(c_,) for c_ in cols], "feature string")
    both = (F.coalesce("n_ref", F.lit(0)) > 0) & (F.coalesce("n_cur", F.lit(0)) > 0)
    return _with_ks(feats.join(ks, "feature", "left").withColumn("D", F.when(both, F.col("D")))).select("feature", "ks_statistic", "p_value")


def psi(reference: DataFrame, current: DataFrame, cols: Sequence[str], n_bins: int = PSI_BINS) -> DataFrame:
    """PSI on the reference's exact decile edges (unique), outer edges open on
    both sides, +1e-6 smoothing."""
    return feature_stats(reference, current, cols, n_bins).select("feature", "psi")


def chi2_statistic(reference: DataFrame, current: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Chi-square of current counts against reference proportions over the
    union of categories: expected = (p_ref + 1e-10) * len(current)."""
    def long(df, side):
        return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value"))
                                             for c in cols])).alias("s")).select("s.*").withColumn("side", F.lit(side))
    both = long(reference, "ref").unionByName(long(current, "cur"))
    n_cur_rows = current.agg(F.count(F.lit(1)).alias("n_cur_rows"))
    counts = both.where(F.col("value").isNotNull()).groupBy("feature", "value").agg(
        F.count_if(F.col("side") == "ref").alias("r"), F.count_if(F.col("side") == "cur").alias("o"))
    tot = counts.groupBy("feature").agg(F.sum("r").alias("r_tot"), F.count(F.lit(1)).alias("k"))
    j = counts.join(tot, "feature").crossJoin(n_cur_rows)
    ref_p = F.when(F.col("r_tot") > 0, F.col("r") / F.col("r_tot")).otherwise(F.col("r").cast("double"))
    exp_ = (ref_p + F.lit(CHI2_EPS)) * F.col("n_cur_rows")
    return j.groupBy("feature").agg(F.sum((F.col("o") - exp_) * (F.col("o") - exp_) / exp_).alias("chi2_statistic"),
                                    (F.first("k") - 1).alias("dof"))


# ---------------------------------------------------------------- chi-square tail probability

def _gammainc_upper(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma Q(a, x): series for x < a+1,
    continued fraction otherwise (vectorised numpy; no scipy)."""
    from math import lgamma
    out = np.ones_like(x, dtype=float)
    for i, (ai, xi) in enumerate(zip(a, x)):
        if not np.isfinite(xi) or ai <= 0:
            out[i] = np.nan
            continue
        if xi <= 0:
            out[i] = 1.0
            continue
        lg = lgamma(ai)
        if xi < ai + 1:
            s = term = 1.0 / ai
            n = ai
            for _ in range(10000):
                n += 1
                term *= xi / n
                s += term
                if abs(term) < abs(s) * 1e-15:
                    break
            out[i] = 1.0 - s * np.exp(-xi + ai * np.log(xi) - lg)
        else:
            tiny = 1e-300
            b = xi + 1 - ai
            c = 1 / tiny
            d = 1 / b
            h = d
            for k in range(1, 10000):
                an = -k * (k - ai)
                b += 2
                d = an * d + b
                d = tiny if abs(d) < tiny else d
                c = b + an / c
                c = tiny if abs(c) < tiny else c
                d = 1 / d
                delta = d * c
                h *= delta
                if abs(delta - 1) < 1e-15:
                    break
            out[i] = np.exp(-xi + ai * np.log(xi) - lg) * h
    return np.clip(out, 0.0, 1.0)


@F.pandas_udf(T.DoubleType())
def chi2_sf(stat: pd.Series, dof: pd.Series) -> pd.Series:
    """P(X > stat) for X ~ chi2(dof); applied to one row per feature."""
    a = dof.astype(float).to_numpy() / 2.0
    x = stat.astype(float).to_numpy() / 2.0
    return pd.Series(_gammainc_upper(a, x))


def chi2_drift(reference: DataFrame, current: DataFrame, cols: Sequence[str]) -> DataFrame:
    st = chi2_statistic(reference, current, cols)
    p = chi2_sf(F.col("chi2_statistic"), F.col("dof"))
    return st.withColumn("p_value", p).withColumn("is_drifted", F.col("p_value") < F.lit(ALERT_P)).withColumn(
        "interpretation", F.when(F.col("p_value") > ALERT_P, CATEGORICAL_LABELS[0])
        .when(F.col("chi2_statistic") < 10, CATEGORICAL_LABELS[1])
        .when(F.col("chi2_statistic") < 25, CATEGORICAL_LABELS[2]).otherwise(CATEGORICAL_LABELS[3]))


def drift_record(reference: DataFrame, current: DataFrame, cols: Sequence[str], alert_p: float = ALERT_P,
                 categorical: Sequence[str] = (), min_ref: int = 0, min_cur: int = 0) -> DataFrame:
    """Per numeric feature: KS, p, PSI (4-dec half-even rounding), drifted flag,
    interpretation, reference/current mean and population std; features with
    fewer than ``min_ref`` / ``min_cur`` values are left out.  ``categorical``
    features join the same record with their chi-square test (statistic in
    ``ks_statistic``'s place is null)."""
    out = _with_ks(feature_stats(reference, current, cols))
    if min_ref or min_cur:
        out = out.where((F.col("n_ref") >= min_ref) & (F.col("n_cur") >= min_cur))
    p = F.col("p_value")
    interp = (F.when(p > alert_p, NUMERIC_LABELS[0]).when(F.col("psi") < 0.1, NUMERIC_LABELS[1])
              .when(F.col("psi") < 0.25, NUMERIC_LABELS[2]).otherwise(NUMERIC_LABELS[3]))
    rec = out.select("feature", F.lit("KS").alias("drift_test"),
                     F.bround("ks_statistic", 4).alias("ks_statistic"), F.bround(p, 4).alias("p_value"),
                     F.bround("psi", 4).alias("psi"), (p < alert_p).alias("is_drifted"), interp.alias("interpretation"),
                     F.col("ref_mean").alias("reference_mean"), F.col("cur_mean").alias("current_mean"),
                     F.col("ref_std").alias("reference_std"), F.col("cur_std").alias("current_std"))
    if categorical:
        chi = chi2_drift(reference, current, categorical)
        none = F.lit(None).cast("double")
        rec = rec.unionByName(chi.select("feature", F.lit("chi2").alias("drift_test"), none.alias("ks_statistic"), F.bround("p_value", 4).alias("p_value"),
                                         none.alias("psi"), (F.col("p_value") < alert_p).alias("is_drifted"), "interpretation",
                                         *[none.alias(c) for c in ("reference_mean", "current_mean", "reference_std", "current_std")]))
    return rec


def drift_summary(records: DataFrame) -> DataFrame:
    return records.agg(F.count(F.lit(1)).alias("n_features"), F.count_if("is_drifted").alias("n_drifted"),
                       F.bround(F.try_divide(F.count_if("is_drifted") * F.lit(100.0), F.count(F.lit(1))), 2)
                       .alias("drift_pct"))


def target_drift(reference: DataFrame, current: DataFrame, label: str) -> DataFrame:
    """2 x k contingency chi-square (Yates-corrected when 2 x 2) and positive rates."""
    r = reference.groupBy(F.col(label).alias("cls")).agg(F.count(F.lit(1)).alias("n_a"))
    c = current.groupBy(F.col(label).alias("cls")).agg(F.count(F.lit(1)).alias("n_b"))
    t = r.join(c, "cls", "full").fillna(0, ["n_a", "n_b"])
    tot = t.agg(F.sum("n_a").alias("tot_a"), F.sum("n_b").alias("tot_b"), F.count(F.lit(1)).alias("k"))
    j = t.crossJoin(tot)
    n = F.col("tot_a") + F.col("tot_b")
    row = F.col("n_a") + F.col("n_b")
    ea, eb = F.col("tot_a") * row / n, F.col("tot_b") * row / n
    yates = F.when(F.col("k") == 2, F.lit(0.5)).otherwise(F.lit(0.0))

    def term(o, e):
        dev = F.greatest(F.abs(o - e) - yates, F.lit(0.0))
        return F.try_divide(dev * dev, e)
    s = j.groupBy().agg(F.sum(term(F.col("n_a"), ea) + term(F.col("n_b"), eb)).alias("chi2_statistic"),
                        (F.first("k") - 1).alias("dof"),
                        F.try_divide(F.sum(F.when(F.col("cls") == 1, F.col("n_a"))), F.first("tot_a")).alias("reference_positive_rate"),
                        F.try_divide(F.sum(F.when(F.col("cls") == 1, F.col("n_b"))), F.first("tot_b")).alias("current_positive_rate"))
    return s


def prediction_drift(reference: DataFrame, current: DataFrame, score: str) -> DataFrame:
    """KS on scores plus mean shift and relative shift (%)."""
    ks = ks_drift(reference, current, [score]).drop("feature")
    m = reference.agg(F.avg(score).alias("reference_mean")).crossJoin(current.agg(F.avg(score).alias("current_mean")))
    return ks.crossJoin(m).withColumn("mean_shift", F.col("current_mean") - F.col("reference_mean")).withColumn(
        "pct_shift", F.try_divide(F.col("mean_shift") * F.lit(100.0), F.col("reference_mean")))


def batch_drift(reference: DataFrame, current: DataFrame, min_ref: int = 10, min_cur: int = 5,
                exclude: Sequence[str] = ()) -> DataFrame:
    """Drift records for every numeric column shared by both tables that has
    at least ``min_ref`` / ``min_cur`` non-null values, from one count table."""
    num = ("int", "bigint", "smallint", "tinyint", "double", "float")
    shared = [f.name for f in reference.schema.fields
              if f.dataType.simpleString() in num and f.name in current.columns and f.name not in exclude]
    return drift_record(reference, current, shared, min_ref=min_ref, min_cur=min_cur)


def persist_drift(records: DataFrame, path: str, batch_id: str) -> DataFrame:
    """Add drift records (both KS and PSI kept -- no 'psi or ks' fallback) to a table
    partitioned by batch id; a batch written again replaces itself.  Returns the
    re-read batch."""
    from riskframe.sources.batches import read_batches, write_batch
    rec = records.withColumn("batch_id", F.lit(batch_id)).withColumn("recorded_at", F.current_timestamp())
    write_batch(rec, path, "batch_id")
    return read_batches(records.sparkSession, path, "batch_id").where(F.col("batch_id") == batch_id)
