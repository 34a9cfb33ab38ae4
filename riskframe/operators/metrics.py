"""Model evaluation as queries over (label, score) tables.

Everything reduces the scored table first -- to one row per distinct score
(ROC / PR / AP / F-beta), to <= 100 threshold buckets (sweeps) or to 50 bins
(histograms) -- so no step keeps row-level data in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.operators.ordered import running_sum

# fixed values: cost of a missed default vs a false alarm, F-beta weight
COST_FN = 10.0
COST_FP = 1.0
BETA = 3.2


def _z(num: Column, den: Column) -> Column:
    """num / den, 0 when the denominator is 0 (sklearn's zero_division=0)."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def confusion_at(df: DataFrame, label: str, score: str, threshold: float) -> DataFrame:
    y, p = F.col(label), F.col(score) >= F.lit(threshold)
    return df.agg(F.count_if((y == 1) & p).alias("tp"), F.count_if((y == 0) & p).alias("fp"),
                  F.count_if((y == 1) & ~p).alias("fn"), F.count_if((y == 0) & ~p).alias("tn"))


def with_rates(c: DataFrame, beta: float = BETA, cost_fn: float = COST_FN, cost_fp: float = COST_FP) -> DataFrame:
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    prec, rec = _z(tp, tp + fp), _z(tp, tp + fn)
    b2 = beta * beta
    return c.withColumns({
        "accuracy": _z(tp + tn, tp + fp + fn + tn), "precision": prec, "recall": rec,
        "f1": _z(F.lit(2.0) * prec * rec, prec + rec),
        "fbeta": _z(F.lit(1 + b2) * prec * rec, F.lit(b2) * prec + rec),
        "fpr": _z(fp, fp + tn), "fnr": _z(fn, fn + tp),
        "cost": (F.lit(cost_fn) * fn + F.lit(cost_fp) * fp).cast("double")})


def confusion(df: DataFrame, label: str, pred: str) -> DataFrame:
    """2x2 counts with row-normalised shares (actual class rows)."""
    g = df.groupBy(F.col(label).alias("actual"), F.col(pred).alias("predicted")).count()
    tot = g.groupBy("actual").agg(F.sum("count").alias("__n"))
    return g.join(tot, "actual").select("actual", "predicted", "count",
                                        (F.col("count") / F.col("__n")).alias("row_share"))


def class_metrics(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    return with_rates(confusion_at(df, label, score, threshold))


def score_table(df: DataFrame, label: str, score: str, groups: Sequence[str] = ()) -> DataFrame:
    """One row per (groups, distinct score): positives and negatives."""
    return df.where(F.col(score).isNotNull()).groupBy(*groups, F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))


def curve_table(df: DataFrame, label: str, score: str, groups: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """Per distinct threshold (descending): cumulative tp / fp and class totals."""
    st = score_table(df, label, score, groups)
    cum = running_sum(st, "score", ["pos", "neg"], groups, ascending=False, ranges=ranges, totals=True)
    return cum.withColumnsRenamed({"cum_pos": "tp", "cum_neg": "fp", "tot_pos": "P", "tot_neg": "N"})


def curve_metrics(df: DataFrame, label: str, score: str, groups: Sequence[str] = (), beta: float = BETA,
                  rates: bool = False) -> DataFrame:
    """ROC AUC (tie-aware trapezoids), average precision (step sum) and the
    best F-beta with its threshold and cost -- one pass over one curve table.
    ``rates`` adds accuracy, precision, recall and F1 at that threshold."""
    c = curve_table(df, label, score, groups)
    b2 = beta * beta
    tp, fp, pos, neg = F.col("tp"), F.col("fp"), F.col("pos"), F.col("neg")
    fn = F.col("P") - tp
    area = neg * (F.lit(2.0) * tp - pos) / F.lit(2.0)
    ap = F.when(F.col("P") > 0, pos / F.col("P") * (tp / (tp + fp)))
    fb = _z(F.lit(1 + b2) * tp, F.lit(1 + b2) * tp + F.lit(b2) * fn + fp)
    cost = F.lit(COST_FN) * fn + F.lit(COST_FP) * fp
    r = c.groupBy(*groups).agg(
        F.try_divide(F.sum(area), F.first("P") * F.first("N")).alias("roc_auc"),
        F.sum(ap).alias("average_precision"),
        F.max(F.struct(fb.alias("fbeta"), (-F.col("score")).alias("neg_t"), cost.alias("c"), tp.alias("tp"), fp.alias("fp"))).alias("b"),
        F.first("P").alias("__p"), F.first("N").alias("__n"))
    t, f, p, n = F.col("b.tp"), F.col("b.fp"), F.col("__p"), F.col("__n")
    extra = [((t + n - f) / (p + n)).alias("accuracy"), _z(t, t + f).alias("precision"), _z(t, p).alias("recall"),
             _z(F.lit(2.0) * t, t + f + p).alias("f1")] if rates else []
    return r.select(*groups, "roc_auc", "average_precision", F.col("b.fbeta").alias("best_fbeta"),
                    (-F.col("b.neg_t")).alias("best_threshold"), F.col("b.c").alias("cost"),
                    (F.col("b.c") / (F.col("__p") + F.col("__n"))).alias("avg_cost"), *extra)


def roc_auc(df: DataFrame, label: str, score: str, groups: Sequence[str] = ()) -> DataFrame:
    return curve_metrics(df, label, score, groups).select(*groups, "roc_auc")


def average_precision(df: DataFrame, label: str, score: str, groups: Sequence[str] = ()) -> DataFrame:
    return curve_metrics(df, label, score, groups).select(*groups, "average_precision")


def best_fbeta(df: DataFrame, label: str, score: str, beta: float = BETA, groups: Sequence[str] = ()) -> DataFrame:
    """Max F-beta over all distinct thresholds (predict positive when score >=
    threshold); ties -> smallest threshold; cost 10 FN + FP at that threshold."""
    return curve_metrics(df, label, score, groups, beta).select(
        *groups, "best_fbeta", "best_threshold", "cost", "avg_cost")


def roc_points(df: DataFrame, label: str, score: str) -> DataFrame:
    c = curve_table(df, label, score)
    return c.select(F.col("score").alias("threshold"), _z(F.col("fp"), F.col("N")).alias("fpr"),
                    _z(F.col("tp"), F.col("P")).alias("tpr"))


def pr_points(df: DataFrame, label: str, score: str) -> DataFrame:
    c = curve_table(df, label, score)
    return c.select(F.col("score").alias("threshold"), _z(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                    _z(F.col("tp"), F.col("P")).alias("recall"))


def threshold_grid(spark, n: int = 99, start: float = 0.01, step: float = 0.01) -> DataFrame:
    """Thresholds start + i*step (as doubles), i = 0..n-1."""
    return spark.range(n).select(F.col("id").alias("i"),
                                 (F.lit(start) + F.col("id").cast("double") * F.lit(step)).alias("threshold"))


def _grid_index(score: Column, start: float, step: float, n: int) -> Column:
    """Number of grid thresholds t_i = start + i*step with t_i <= score, exact
    in double arithmetic (estimate, then fix with two comparisons)."""
    est = F.floor((score - F.lit(start)) / F.lit(step)).cast("bigint")
    t0 = F.lit(start) + est.cast("double") * F.lit(step)
    t1 = F.lit(start) + (est + 1).cast("double") * F.lit(step)
    k = est + F.when(t0 <= score, 1).otherwise(0) + F.when(t1 <= score, 1).otherwise(0)
    return F.least(F.greatest(k, F.lit(0)), F.lit(n))


def threshold_sweep(df: DataFrame, label: str, score: str, n: int = 99, start: float = 0.01,
                    step: float = 0.01) -> DataFrame:
    """Confusion counts and rates at every grid threshold, from a <= n+1 row
    histogram (never data x thresholds); flags the first minimum-cost threshold."""
    h = df.where(F.col(score).isNotNull()).groupBy(
        _grid_index(F.col(score).cast("double"), start, step, n).alias("k")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    grid = threshold_grid(df.sparkSession, n, start, step)
    # grid (n rows) x histogram (<= n+1 rows): bounded on both sides
    x = grid.crossJoin(F.broadcast(h)).groupBy("i", "threshold").agg(
        F.coalesce(F.sum(F.when(F.col("k") > F.col("i"), F.col("pos"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(F.col("k") > F.col("i"), F.col("neg"))), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.when(F.col("k") <= F.col("i"), F.col("pos"))), F.lit(0)).alias("fn"),
        F.coalesce(F.sum(F.when(F.col("k") <= F.col("i"), F.col("neg"))), F.lit(0)).alias("tn"))
    r = with_rates(x)
    best = r.agg(F.min(F.struct("cost", "threshold")).alias("m")).select(F.col("m.threshold").alias("__best"))
    return r.crossJoin(best).withColumn("is_optimal", F.col("threshold") == F.col("__best")).drop("__best", "i")


def nearest_threshold(sweep: DataFrame, t: float) -> DataFrame:
    """Row of a precomputed sweep closest to ``t`` (ties -> smaller threshold)."""
    m = sweep.agg(F.min(F.struct(F.abs(F.col("threshold") - F.lit(t)).alias("d"), F.col("threshold").alias("th")))
                  .alias("m")).select(F.col("m.th").alias("threshold"))
    return sweep.join(m, "threshold", "left_semi")


def score_hist(df: DataFrame, label: str, score: str, bins: int = 50, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Per class, equal-width bins over [lo, hi], last bin closed; density."""
    width = (hi - lo) / bins
    b = F.least(F.floor((F.col(score) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("bigint")
    h = df.where(F.col(score).between(lo, hi)).groupBy(F.col(label).alias("label"), b.alias("bin")).count()
    n = h.groupBy("label").agg(F.sum("count").alias("__n"))
    return h.join(n, "label").select("label", "bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_start"),
                                     "count", (F.col("count") / (F.col("__n") * F.lit(width))).alias("density"))


def class_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """precision / recall / f1 / support per class (one-vs-rest)."""
    g = df.groupBy(F.col(label).alias(label), F.col(pred).alias(pred)).agg(F.count(F.lit(1)).alias("__n"))
    classes = g.select(F.col(label).alias("cls")).union(g.select(F.col(pred).alias("cls"))).distinct()
    # both sides are bounded by (number of classes)^2 rows: counts first, then one-vs-rest
    x = g.crossJoin(F.broadcast(classes)).groupBy("cls").agg(
        F.coalesce(F.sum(F.when((F.col(label) == F.col("cls")) & (F.col(pred) == F.col("cls")), F.col("__n"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when((F.col(label) != F.col("cls")) & (F.col(pred) == F.col("cls")), F.col("__n"))), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.when((F.col(label) == F.col("cls")) & (F.col(pred) != F.col("cls")), F.col("__n"))), F.lit(0)).alias("fn"))
    p, r = _z(F.col("tp"), F.col("tp") + F.col("fp")), _z(F.col("tp"), F.col("tp") + F.col("fn"))
    return x.select(F.col("cls").alias("class"), p.alias("precision"), r.alias("recall"),
                    _z(F.lit(2.0) * p * r, p + r).alias("f1"), (F.col("tp") + F.col("fn")).alias("support"))


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Write a small result table (e.g. a threshold sweep) and read it back,
    so later lookups never recompute it from the scored data."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
