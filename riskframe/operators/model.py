"""Model jobs on MLlib plus exact linear scoring / contributions.

Training and cross-validation loop on the driver over a handful of folds;
every fit and every transform is a distributed MLlib job.  Linear scoring is
a pure column expression (no UDF), so batch scoring is map-only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.exprs import risk_band
from riskframe.sources.io import materialize, scratch_path


#: the ten metrics of a fold
METRICS = ("roc_auc", "average_precision", "best_fbeta", "best_threshold", "cost", "avg_cost", "accuracy", "precision", "recall", "f1")

#: rows of a training table that one task reads at most
TASK_ROWS = 100_000


def _pipeline(features: Sequence[str], clf, medians: Mapping[str, float | None], scale: bool = True) -> Pipeline:
    """Exact training medians (0 where a column has none) fill the gaps."""
    fill = ", ".join(f"COALESCE(CAST(`{c}` AS DOUBLE), {float(medians.get(c) or 0.0)!r}D) AS `__i_{c}`" for c in features)
    imp = SQLTransformer(statement=f"SELECT *, {fill} FROM __THIS__")
    asm = VectorAssembler(inputCols=[f"__i_{c}" for c in features], outputCol="__raw")
    stages = [imp, asm]
    if scale:
        stages.append(StandardScaler(inputCol="__raw", outputCol="features", withMean=True, withStd=True))
    else:
        asm.setOutputCol("features")
    return Pipeline(stages=stages + [clf])


def with_balanced_weight(df: DataFrame, label: str, weight: str = "weight") -> DataFrame:
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("__cnt"))
    t = c.agg(F.sum("__cnt").alias("__tot"), F.count(F.lit(1)).alias("__k"))
    w = c.crossJoin(t).select(label, (F.col("__tot") / (F.col("__k") * F.col("__cnt"))).alias(weight))
    return df.join(F.broadcast(w), label)   # one row per class


def classifier(kind: str, label: str, seed: int = 42, **params):
    if kind == "lr":
        return LogisticRegression(labelCol=label, weightCol="weight", maxIter=params.get("maxIter", 100), tol=params.get("tol", 1e-6),
                                  regParam=params.get("regParam", 0.0), elasticNetParam=params.get("elasticNetParam", 0.0))
    if kind == "rf":
        return RandomForestClassifier(labelCol=label, weightCol="weight", numTrees=params.get("numTrees", 100),
                                      maxDepth=params.get("maxDepth", 5), seed=seed)
    if kind == "gbt":
        return GBTClassifier(labelCol=label, weightCol="weight", maxIter=params.get("maxIter", 20),
                             maxDepth=params.get("maxDepth", 3), seed=seed)
    raise ValueError(kind)


def fit(df: DataFrame, features: Sequence[str], label: str, kind: str = "lr", medians: Mapping[str, float | None] | None = None, **params):
    """``medians``: of the training rows; computed here if not given.  The
    training table is written once and dealt by rows: every iteration of the
    solver reads it."""
    if medians is None:
        from riskframe.operators.fit import fit_medians
        medians = fit_medians(df, features)
    d = with_balanced_weight(df.withColumn(label, F.col(label).cast("double")), label)
    return _pipeline(features, classifier(kind, label, **params), medians, scale=(kind == "lr")).fit(training_table(d))


def training_table(df: DataFrame, name: str = "train") -> DataFrame:
    """The table written once and dealt so that a task reads at most ``TASK_ROWS`` of its
    rows (Spark packs files by bytes, but a tree learner's bagged points take over 1 KB
    each).  Tables that are dealt finer stay as they are."""
    t = materialize(df, name)
    n = -(-t.count() // TASK_ROWS)
    return t.repartition(n) if n > t.rdd.getNumPartitions() else t


#: half-width of the rank bracket around the median of all rows, as a share of them: holds the median of a
#: fold's training rows but for uneven folds, which is checked
FOLD_BRACKET = 0.01


def _value(c: str):
    v = F.col(f"`{c}`").cast("double")
    return F.when(~F.isnan(v), v)


def fold_medians(df: DataFrame, features: Sequence[str], k: int) -> dict[int, dict[str, float]]:
    """Exact medians of the training rows of every fold (the rows of the other
    folds); k x columns values reach the driver.

    Two approximate quantiles of all rows bracket a column's medians for every fold; only
    values inside are counted by fold and ranked.  Columns whose medians leave the bracket go
    through ``exact_quantiles``."""
    from riskframe.operators.ordered import ACCURACY, SMALL_GROUP, running_sum
    out: dict[int, dict[str, float]] = {f: {} for f in range(k)}
    rows = df.where(F.col("fold").isNotNull()).select("fold", *[_value(c).alias(f"c{i}") for i, c in enumerate(features)])
    cols = [f"c{i}" for i in range(len(features))]
    if not cols:
        return out
    ends = [0.5 - FOLD_BRACKET, 0.5 + FOLD_BRACKET]
    seen = rows.agg(*[F.struct(F.count(c), F.min(c), F.max(c), F.percentile_approx(c, ends, ACCURACY)).alias(c) for c in cols]).first()
    edges = {c: (seen[c][1], seen[c][2]) if seen[c][0] < SMALL_GROUP else tuple(seen[c][3]) for c in cols if seen[c][0]}
    if not edges:
        return out
    counts = {r["fold"]: r for r in rows.groupBy("fold").agg(*[F.struct(F.count(c), F.count_if(F.col(c) < F.lit(lo)), F.count_if(F.col(c) <= F.lit(hi))).alias(c)
                                                               for c, (lo, hi) in edges.items()]).collect()}
    want, far = {}, set()
    for c in edges:
        for f in range(k):
            n, below, upto = (sum(r[c][j] for g, r in counts.items() if g != f) for j in range(3))
            if n:
                want[f, c] = (n, below)
                if below > (n - 1) // 2 or upto <= n // 2:
                    far.add(c)
    near = [c for c in edges if c not in far]
    if near:
        inside = F.filter(F.array(*[F.struct(F.lit(c).alias("feature"), F.when(F.col(c).between(*edges[c]), F.col(c)).alias("v")) for c in near]), lambda x: x["v"].isNotNull())
        by = rows.select("fold", F.inline(inside)).groupBy("feature", "v").agg(*[F.count_if(F.col("fold") != f).alias(f"n{f}") for f in range(k)])
        cum = running_sum(by, "v", [f"n{f}" for f in range(k)], ["feature"])
        table = df.sparkSession.createDataFrame([(c, [want.get((f, c), (0, 0))[0] for f in range(k)], [want.get((f, c), (0, 0))[1] for f in range(k)]) for c in near],
                                                "feature string, n array<long>, below array<long>")
        j = cum.join(F.broadcast(table), "feature")                 # one row per column

        def at(f: int, rank: str):
            last = F.col("below")[f] + F.col(f"cum_n{f}") - 1
            return F.max(F.when((F.expr(rank) <= last) & (F.expr(rank) > last - F.col(f"n{f}")), F.col("v")))

        for r in j.groupBy("feature").agg(*[F.struct(at(f, f"(n[{f}] - 1) div 2"), at(f, f"n[{f}] div 2")).alias(f"m{f}") for f in range(k)]).collect():
            for f in range(k):
                lo, hi = r[f"m{f}"]
                if (f, r["feature"]) in want:
                    out[f][features[int(r["feature"][1:])]] = lo + (0.5 if want[f, r["feature"]][0] % 2 == 0 else 0.0) * (hi - lo)
    if far:
        for f, got in _uneven_medians(df, [features[int(c[1:])] for c in cols if c in far], k).items():
            out[f].update(got)
    return out


def _uneven_medians(df: DataFrame, features: Sequence[str], k: int) -> dict[int, dict[str, float]]:
    """``fold_medians`` from one distributed quantile job over every (fold, column)."""
    from riskframe.operators.ordered import exact_quantiles
    others = F.filter(F.array(*[F.lit(f) for f in range(k)]), lambda f: f != F.col("fold"))
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("value")) for c in features])
    long = df.select(F.explode(others).alias("without"), cells.alias("__c")).select("without", F.inline("__c"))
    out: dict[int, dict[str, float]] = {f: {} for f in range(k)}
    for r in exact_quantiles(long, "value", [0.5], ["without", "feature"]).collect():
        out[r.without][r.feature] = r.quantile
    return out


def score(model, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    out = model.transform(df)
    p = vector_to_array("probability")[1]
    return out.select(*keep, p.alias("probability"), F.col("prediction").cast("int").alias("prediction"),
                      risk_band(p).alias("risk_level"))


def cross_validate(df: DataFrame, features: Sequence[str], label: str, key: str, folds: DataFrame,
                   k: int = 5, kind: str = "lr", resample=None, out: str | None = None,
                   **params) -> tuple[DataFrame, DataFrame]:
    """k-fold CV: per fold fit on the other folds (optionally resampled),
    score the held-out fold.  Fold scores are appended to a Parquet table
    under the shared checkpoint folder (lineage cut per fold, so a lost
    executor never recomputes earlier folds).  Returns (out-of-fold
    predictions, per-fold metrics)."""
    from riskframe.operators import metrics as M
    spark = df.sparkSession
    out = out or scratch_path(spark, "oof")
    base = materialize(df.join(folds.select(key, "fold"), key), "folds")
    medians = fold_medians(base, features, k)
    for f in range(k):
        tr = base.where(F.col("fold") != f)
        if resample is not None:
            tr = resample(tr)
        model = fit(tr, features, label, kind, medians[f], **params)
        score(model, base.where(F.col("fold") == f), [key, label]).write.mode("overwrite").parquet(f"{out}/fold={f}")
    oof = spark.read.parquet(out)
    return oof, M.curve_metrics(oof, label, "probability", ["fold"], rates=True)


# ---------------------------------------------------------------- exact linear model

def linear_score(df: DataFrame, weights: Mapping[str, float], intercept: float, scaler: Mapping[str, tuple],
                 keep: Sequence[str]) -> DataFrame:
    """p = sigmoid(b0 + sum w_i * (x_i - mean_i) / std_i) as one expression."""
    z = F.lit(intercept)
    for c, w in weights.items():
        m, s = scaler[c]
        z = z + F.lit(w) * (F.col(c).cast("double") - F.lit(m)) / F.lit(s)
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    return df.select(*keep, p.alias("probability"), risk_band(p).alias("risk_level"))


def linear_contributions(df: DataFrame, weights: Mapping[str, float], scaler: Mapping[str, tuple], key: Sequence[str]) -> DataFrame:
    """Exact additive contributions w_i * (x_i - mean_i) / std_i per (row, feature),
    for every row (the reference limited tree SHAP to 1000 rows)."""
    return df.select(*key, F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"),
                 (F.lit(w) * (F.col(c).cast("double") - F.lit(scaler[c][0])) / F.lit(scaler[c][1])).alias("contribution"))
        for c, w in weights.items()])).alias("s")).select(*key, "s.*")


def explain_text(df: DataFrame, weights: Mapping[str, float], scaler: Mapping[str, tuple], key: Sequence[str], top: int = 5) -> DataFrame:
    """Per row: top-k ``feature (value): contribution`` joined by '; ' -- an
    expression over the row's own array of contributions (no exchange)."""
    parts = F.array(*[F.struct(
        (-F.abs(F.lit(w) * (F.col(c).cast("double") - F.lit(scaler[c][0])) / F.lit(scaler[c][1]))).alias("neg_abs"), F.lit(c).alias("feature"),
        F.col(c).cast("double").alias("value"), (F.lit(w) * (F.col(c).cast("double") - F.lit(scaler[c][0])) / F.lit(scaler[c][1])).alias("contribution"))
        for c, w in weights.items()])
    best = F.slice(F.sort_array(F.filter(parts, lambda s: s["contribution"].isNotNull())), 1, top)
    txt = F.transform(best, lambda s: F.format_string("%s (%.4f): %+.3f", s["feature"], s["value"], s["contribution"]))
    return df.select(*key, F.concat_ws("; ", txt).alias("explanation"), F.size(best).alias("__n")).where("__n > 0").drop("__n")


def feature_importance(model, features: Sequence[str], raw: Sequence[str] = ()) -> DataFrame:
    """Tree-model importances as a (feature, importance, source) table."""
    from riskframe.operators.profile import feature_source
    from pyspark.sql import SparkSession
    spark = SparkSession.active()
    imp = model.stages[-1].featureImportances.toArray().tolist()
    df = spark.createDataFrame(list(zip(features, [float(x) for x in imp])), "feature string, importance double")
    return df.withColumn("source", feature_source(F.col("feature"), list(raw)))


def submission(model, df: DataFrame, key: str, threshold: float) -> DataFrame:
    """id, probability of default, class at the chosen threshold."""
    s = score(model, df, [key])
    return s.select(key, "probability", (F.col("probability") >= F.lit(threshold)).cast("int").alias("predicted_class"))
