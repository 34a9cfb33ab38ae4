"""Model jobs (K) over the application role."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.operators import features as FT
from riskframe.operators import fit as FI
from riskframe.operators import metrics as M
from riskframe.operators import model as MD
from riskframe.operators import search as SE
from riskframe.operators.sample import stratified_kfold, stratified_split, undersample
from riskframe.plans.bind import role, with_roles
from riskframe.plans.q_features import POLY_COLS
from riskframe.plans.registry import query
from riskframe.plans.sqlgen import rnd_sql, round_double_cols

ORACLE: dict[str, str] = {}
FEATS = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3", "DAYS_BIRTH", "CNT_CHILDREN",
         "OWN_CAR_AGE"]
APP = with_roles("application")


def reg(k, s):
    ORACLE[k] = s


def _data(spark, d):
    a = role(spark, d, "application").select("SK_ID_CURR", "TARGET", *[F.col(c).cast("double").alias(c) for c in FEATS])
    s = stratified_split(a, "SK_ID_CURR", "TARGET", 0.7)
    return s.where("split = 'train'").drop("split"), s.where("split = 'val'").drop("split")


def _train_eval(spark, d, kind, **params):
    tr, va = _data(spark, d)
    model = MD.fit(tr, FEATS, "TARGET", kind, **params)
    sc = MD.score(model, va, ["SK_ID_CURR", "TARGET"])
    return sc.agg(F.count(F.lit(1)).alias("n_scored")).crossJoin(M.roc_auc(sc, "TARGET", "probability")) \
        .crossJoin(M.best_fbeta(sc, "TARGET", "probability")).withColumn("model", F.lit(kind))


@query("train_lr")
def q_train_lr(spark, d):
    return _train_eval(spark, d, "lr")


@query("train_rf")
def q_train_rf(spark, d):
    return _train_eval(spark, d, "rf", numTrees=100)


@query("train_gbt")
def q_train_gbt(spark, d):
    return _train_eval(spark, d, "gbt", maxIter=100, maxDepth=6)


def _cv(spark, d):
    a = role(spark, d, "application").select("SK_ID_CURR", "TARGET", *[F.col(c).cast("double").alias(c) for c in FEATS])
    folds = stratified_kfold(a, "SK_ID_CURR", "TARGET", 5).select("SK_ID_CURR", "fold")
    return MD.cross_validate(a, FEATS, "TARGET", "SK_ID_CURR", folds, 5, "lr",
                             resample=lambda t: undersample(t, "SK_ID_CURR", "TARGET", 1, 1.0))


@query("cv_run")
def q_cv_run(spark, d):
    _, mets = _cv(spark, d)
    return mets


@query("oof_predictions")
def q_oof(spark, d):
    oof, _ = _cv(spark, d)
    return oof


# fixed values: a stored linear scoring model (weights on standardised inputs)
LINEAR_WEIGHTS = {"EXT_SOURCE_1": -0.9, "EXT_SOURCE_2": -1.1, "EXT_SOURCE_3": -0.8, "AMT_CREDIT": 0.3,
                  "DAYS_BIRTH": 0.25}
LINEAR_INTERCEPT = -1.2


def _lin_state(spark, d):
    a = role(spark, d, "application")
    return a, FI.fit_scaler(a, list(LINEAR_WEIGHTS))


@query("score_linear")
def q_score_linear(spark, d):
    a, sc = _lin_state(spark, d)
    return round_double_cols(MD.linear_score(a, LINEAR_WEIGHTS, LINEAR_INTERCEPT, sc, ["SK_ID_CURR"]))


def _z_sql(c):
    return (f"(CAST({c} AS DOUBLE) - (SELECT AVG(CAST({c} AS DOUBLE)) FROM application)) / "
            f"COALESCE(NULLIF((SELECT STDDEV_POP(CAST({c} AS DOUBLE)) FROM application), 0), 1)")


_LOGIT = f"({LINEAR_INTERCEPT}e0 + " + " + ".join(f"({w}e0) * {_z_sql(c)}" for c, w in LINEAR_WEIGHTS.items()) + ")"
_P = f"(1e0 / (1e0 + exp(-{_LOGIT})))"
reg("score_linear", APP + f"SELECT SK_ID_CURR, {rnd_sql(_P)} AS probability, CASE WHEN {_P} < 0.3e0 THEN 'LOW' WHEN {_P} < 0.5e0 "
    f"THEN 'MEDIUM' WHEN {_P} IS NOT NULL THEN 'HIGH' END AS risk_level FROM application")


def _contribs(spark, d):
    a, sc = _lin_state(spark, d)
    return MD.linear_contributions(a, LINEAR_WEIGHTS, sc, ["SK_ID_CURR"])


@query("contributions")
def q_contributions(spark, d):
    return round_double_cols(_contribs(spark, d))


_CONTRIB_SQL = " UNION ALL ".join(
    f"SELECT SK_ID_CURR, '{c}' AS feature, CAST({c} AS DOUBLE) AS value, ({w}e0) * {_z_sql(c)} AS contribution FROM application"
    for c, w in LINEAR_WEIGHTS.items())
reg("contributions", APP + f"SELECT SK_ID_CURR, feature, {rnd_sql('value')} AS value, {rnd_sql('contribution')} AS contribution FROM ({_CONTRIB_SQL}) c")


@query("global_contrib")
def q_global_contrib(spark, d):
    return round_double_cols(_contribs(spark, d).groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs_contribution")))


reg("global_contrib", APP + f"SELECT feature, {rnd_sql('AVG(abs(contribution))')} AS mean_abs_contribution FROM ({_CONTRIB_SQL}) c GROUP BY feature")


@query("explain_text")
def q_explain_text(spark, d):
    a, sc = _lin_state(spark, d)
    return MD.explain_text(a, LINEAR_WEIGHTS, sc, ["SK_ID_CURR"], 3)


reg("explain_text", APP + (
    "SELECT SK_ID_CURR, string_agg(printf('%s (%.4f): %+.3f', feature, value, contribution), '; ' ORDER BY abs(contribution) DESC, feature) "
    f"AS explanation FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY SK_ID_CURR ORDER BY abs(contribution) DESC, feature) AS rn FROM ({_CONTRIB_SQL}) c "
    "WHERE contribution IS NOT NULL) r WHERE rn <= 3 GROUP BY SK_ID_CURR"))


@query("feature_importance")
def q_feature_importance(spark, d):
    """Random-forest importances with provenance tags."""
    tr, _ = _data(spark, d)
    model = MD.fit(tr, FEATS, "TARGET", "rf", numTrees=100)
    raw = role(spark, d, "application").columns
    return MD.feature_importance(model, FEATS, raw)


@query("submission")
def q_submission(spark, d):
    """K8: final fit on the training part, scored rest as (id, probability, class)."""
    tr, va = _data(spark, d)
    model = MD.fit(tr, FEATS, "TARGET", "lr")
    return MD.submission(model, va, "SK_ID_CURR", 0.5)


def _folds(spark, d, cols):
    a = role(spark, d, "application").select("SK_ID_CURR", "TARGET", *[F.col(c).cast("double").alias(c) for c in cols])
    return a, stratified_kfold(a, "SK_ID_CURR", "TARGET", 5).select("SK_ID_CURR", "fold")


@query("experiment_grid")
def q_experiment_grid(spark, d):
    """K5: four feature strategies x four sampling strategies, five folds each."""
    num = FT.numeric_columns(role(spark, d, "application"), ["SK_ID_CURR", "TARGET"])
    a, folds = _folds(spark, d, num)
    strategies = {s: (lambda t, s=s: FT.feature_strategy(t, s, POLY_COLS[:3])) for s in FT.FEATURE_STRATEGIES}
    return SE.experiment_grid(a, "SK_ID_CURR", "TARGET", folds, strategies, workers=8)


@query("random_search")
def q_random_search(spark, d):
    """K6: 20 trials in rounds of five, proposed from the finished ones, five folds each."""
    a, folds = _folds(spark, d, FEATS)
    space = {"regParam": SE.Range(1e-4, 10.0, log=True), "maxIter": SE.Range(20, 100, integer=True)}
    return SE.search(a, FEATS, "TARGET", "SK_ID_CURR", folds, space, trials=20, workers=8)


def _tree_contribs(spark, d, kind, **params):
    from riskframe.operators.trees import tree_contributions
    tr, _ = _data(spark, d)
    model = MD.fit(tr, FEATS, "TARGET", kind, **params)
    a = role(spark, d, "application").select("SK_ID_CURR", *[F.col(c).cast("double").alias(c) for c in FEATS])
    return tree_contributions(model, a, FEATS, ["SK_ID_CURR"])


@query("tree_contributions")
def q_tree_contributions(spark, d):
    """Exact contributions of boosted trees, every row and feature."""
    return _tree_contribs(spark, d, "gbt")


@query("tree_global_contrib")
def q_tree_global_contrib(spark, d):
    """Mean absolute contribution per feature of a random forest, with provenance tags."""
    from riskframe.operators.profile import feature_source
    x = _tree_contribs(spark, d, "rf").groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs_contribution"), F.avg("contribution").alias("mean_contribution"))
    return x.withColumn("source", feature_source(F.col("feature"), role(spark, d, "application").columns))


@query("explain_trees")
def q_explain_trees(spark, d):
    """K12 on boosted trees: the five largest contributions as text."""
    x = _tree_contribs(spark, d, "gbt")
    g = x.groupBy("SK_ID_CURR").agg(F.sort_array(F.collect_list(F.struct((-F.abs("contribution")).alias("o"), "feature", "value", "contribution"))).alias("s"))
    return g.select("SK_ID_CURR", F.concat_ws("; ", F.transform(F.slice("s", 1, 5), lambda s: F.format_string(
        "%s (%.4f): %+.3f", s["feature"], s["value"], s["contribution"]))).alias("explanation"))
