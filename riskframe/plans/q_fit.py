"""Fit / transform queries over the application role."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.operators import features as FT
from riskframe.operators import fit as FI
from riskframe.operators.sample import stratified_split
from riskframe.plans.bind import role, with_roles
from riskframe.plans.registry import query
from riskframe.plans.sqlgen import rnd_sql, round_double_cols
from riskframe.session import ensure_checkpoint_dir

ORACLE: dict[str, str] = {}
APP = with_roles("application")
CATS = ["NAME_CONTRACT_TYPE", "OCCUPATION_TYPE", "ORGANIZATION_TYPE", "CODE_GENDER"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
NUMS = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE", "EXT_SOURCE_1", "EXT_SOURCE_2",
        "EXT_SOURCE_3", "OWN_CAR_AGE", "CNT_CHILDREN", "DAYS_BIRTH"]
HSPLIT = "CAST('0x' || substr(md5(CAST(SK_ID_CURR AS VARCHAR) || '_42'), 1, 8) AS BIGINT) / 4294967296e0 < 0.7e0"


def reg(k, s):
    ORACLE[k] = s


def _app(spark, d):
    return role(spark, d, "application")


def _split(spark, d):
    s = stratified_split(_app(spark, d), "SK_ID_CURR", "TARGET", 0.7)
    return s.where(F.col("split") == "train").drop("split"), s.where(F.col("split") == "val").drop("split")


def _dummies_sql(vocab):
    out = []
    for c, vals in vocab.items():
        for v in vals[1:]:
            out.append(f"CAST(COALESCE(CAST({c} = '{v}' AS INTEGER), 0) AS BIGINT) AS \"{c}_{v}\"")
    return out


VOCAB = {"NAME_CONTRACT_TYPE": SEGMENTS, "OCCUPATION_TYPE": SEGMENTS, "CODE_GENDER": ["F", "M"]}


@query("one_hot")
def q_one_hot(spark, d):
    a = _app(spark, d).select("SK_ID_CURR", *CATS)
    vocab = FI.fit_one_hot(a, CATS, 10)
    return FI.one_hot(a, vocab, CATS)


reg("one_hot", APP + f"SELECT SK_ID_CURR, {', '.join(_dummies_sql(VOCAB))} FROM application")


@query("one_hot_apply")
def q_one_hot_apply(spark, d):
    train, val = _split(spark, d)
    vocab = FI.fit_one_hot(train.select(*CATS), CATS, 10)
    return FI.one_hot(val.select("SK_ID_CURR", *CATS), vocab, CATS)


reg("one_hot_apply", APP + f"SELECT SK_ID_CURR, {', '.join(_dummies_sql(VOCAB))} FROM application WHERE NOT ({HSPLIT})")

STRAT = {"EXT_SOURCE_1": "median", "EXT_SOURCE_3": "mean", "OCCUPATION_TYPE": "mode", "OWN_CAR_AGE": ("constant", 0),
         "AMT_GOODS_PRICE": "median"}


@query("impute_strategies")
def q_impute(spark, d):
    a = _app(spark, d).select("SK_ID_CURR", *STRAT)
    return round_double_cols(FI.impute(a, FI.fit_impute(a, STRAT)))


reg("impute_strategies", APP + (
    "SELECT SK_ID_CURR, "
    + ", ".join(f"CAST({c} IS NULL AS BIGINT) AS {c}_WAS_MISSING" for c in STRAT) + ", "
    + f"{rnd_sql('COALESCE(EXT_SOURCE_1, (SELECT MEDIAN(EXT_SOURCE_1) FROM application))')} AS EXT_SOURCE_1, "
    + f"{rnd_sql('COALESCE(EXT_SOURCE_3, (SELECT AVG(EXT_SOURCE_3) FROM application))')} AS EXT_SOURCE_3, "
    + "COALESCE(OCCUPATION_TYPE, (SELECT OCCUPATION_TYPE FROM application WHERE OCCUPATION_TYPE IS NOT NULL GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1)) AS OCCUPATION_TYPE, "
    + "COALESCE(OWN_CAR_AGE, 0) AS OWN_CAR_AGE, "
    + f"{rnd_sql('COALESCE(AMT_GOODS_PRICE, (SELECT MEDIAN(AMT_GOODS_PRICE) FROM application))')} AS AMT_GOODS_PRICE FROM application"))


@query("impute_drop")
def q_impute_drop(spark, d):
    a = _app(spark, d).select("SK_ID_CURR", "EXT_SOURCE_1", "EXT_SOURCE_3", "OWN_CAR_AGE")
    return round_double_cols(FI.impute(a, FI.fit_impute(a, {"EXT_SOURCE_1": "drop", "OWN_CAR_AGE": "drop", "EXT_SOURCE_3": "mean"})))


reg("impute_drop", APP + f"SELECT SK_ID_CURR, {rnd_sql('EXT_SOURCE_1')} AS EXT_SOURCE_1, OWN_CAR_AGE, CAST(EXT_SOURCE_3 IS NULL AS BIGINT) AS EXT_SOURCE_3_WAS_MISSING, "
    f"{rnd_sql('COALESCE(EXT_SOURCE_3, (SELECT AVG(EXT_SOURCE_3) FROM application))')} AS EXT_SOURCE_3 FROM application WHERE EXT_SOURCE_1 IS NOT NULL AND OWN_CAR_AGE IS NOT NULL")


@query("impute_mode")
def q_impute_mode(spark, d):
    a = _app(spark, d).select("SK_ID_CURR", "OCCUPATION_TYPE")
    return FI.impute(a, FI.fit_impute(a, {"OCCUPATION_TYPE": "mode"}), indicator=False)


reg("impute_mode", APP + "SELECT SK_ID_CURR, COALESCE(OCCUPATION_TYPE, (SELECT OCCUPATION_TYPE FROM application WHERE OCCUPATION_TYPE "
    "IS NOT NULL GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1)) AS OCCUPATION_TYPE FROM application")


@query("fit_medians")
def q_fit_medians(spark, d):
    from riskframe.operators.ordered import column_quantiles
    q = column_quantiles(_app(spark, d), NUMS, [0.5]).select("feature", F.col("quantile").alias("median"))
    return round_double_cols(q)


reg("fit_medians", APP + " UNION ALL ".join(f"SELECT '{c}' AS feature, {rnd_sql(f'MEDIAN(CAST({c} AS DOUBLE))')} AS median FROM application" for c in NUMS))

MED_COLS = ["EXT_SOURCE_1", "EXT_SOURCE_3", "AMT_GOODS_PRICE", "OWN_CAR_AGE"]


@query("impute_median")
def q_impute_median(spark, d):
    train, val = _split(spark, d)
    med = FI.fit_medians(train, MED_COLS)
    return round_double_cols(FI.impute_median(val.select("SK_ID_CURR", *MED_COLS), MED_COLS, med))


reg("impute_median", APP + "SELECT SK_ID_CURR, " + ", ".join(
    f"{rnd_sql(f'COALESCE(CAST({c} AS DOUBLE), (SELECT MEDIAN(CAST({c} AS DOUBLE)) FROM application WHERE {HSPLIT}))')} AS {c}"
    for c in MED_COLS) + f" FROM application WHERE NOT ({HSPLIT})")

SCALE = ["AMT_INCOME_TOTAL", "EXT_SOURCE_2", "DAYS_BIRTH", "CNT_CHILDREN"]


@query("standardize")
def q_standardize(spark, d):
    a = _app(spark, d).select("SK_ID_CURR", *SCALE)
    return round_double_cols(FI.standardize(a, FI.fit_scaler(a, SCALE)))


reg("standardize", APP + "SELECT SK_ID_CURR, " + ", ".join(
    f"{rnd_sql(f'(CAST({c} AS DOUBLE) - (SELECT AVG(CAST({c} AS DOUBLE)) FROM application)) / COALESCE(NULLIF((SELECT STDDEV_POP(CAST({c} AS DOUBLE)) FROM application), 0), 1)')} AS {c}"
    for c in SCALE) + " FROM application")


@query("recover_scaler")
def q_recover_scaler(spark, d):
    a = _app(spark, d).select("SK_ID_CURR", *SCALE)
    sc = FI.standardize(a, FI.fit_scaler(a, SCALE))
    return round_double_cols(FI.recover_scaler(a, sc, "SK_ID_CURR", SCALE), exclude=())


reg("recover_scaler", APP + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {rnd_sql(f'STDDEV_POP(CAST({c} AS DOUBLE))')} AS scale, {rnd_sql(f'AVG(CAST({c} AS DOUBLE))')} AS mean FROM application"
    for c in SCALE))


@query("variance_filter")
def q_variance_filter(spark, d):
    return round_double_cols(FI.variance_filter(_app(spark, d), NUMS))


reg("variance_filter", APP + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {rnd_sql(f'VAR_POP(CAST({c} AS DOUBLE))')} AS variance, COALESCE(VAR_POP(CAST({c} AS DOUBLE)) > 0.01e0, false) AS keep FROM application"
    for c in NUMS))


@query("corr_filter")
def q_corr_filter(spark, d):
    return FI.corr_filter(_app(spark, d), NUMS, 0.95)


def _corr_filter_sql():
    from riskframe.plans.q_profiles import corr_sql
    parts = []
    for j, b in enumerate(NUMS):
        hits = [f"CASE WHEN (SELECT abs({corr_sql(a, b)}) FROM application) > 0.95e0 THEN '{a}' END" for a in NUMS[:j]]
        lst = f"list_sort(list_filter([{', '.join(hits)}], lambda x: x IS NOT NULL))" if hits else "CAST([] AS VARCHAR[])"
        parts.append(f"SELECT '{b}' AS feature, len({lst}) > 0 AS dropped, CASE WHEN len({lst}) > 0 THEN {lst} END AS correlated_with")
    return APP + " UNION ALL ".join(parts)


reg("corr_filter", _corr_filter_sql())


def train_score_marts(spark, d):
    """Train: domain -> one-hot -> median impute -> scale, all state fitted on
    the training split only; score: the same state applied to the rest."""
    from riskframe.plans.q_marts import build_mart
    mart = build_mart(spark, d).drop("RISK_BAND")
    app = _app(spark, d).select("SK_ID_CURR", *[c for c in _app(spark, d).columns if c not in mart.columns])
    # the mart feeds three fits and two transforms: cut its lineage once
    # (reliable checkpoint in spark.checkpoint.dir, survives executor loss)
    ensure_checkpoint_dir(spark)
    full = FT.domain_features(mart.join(app, "SK_ID_CURR")).checkpoint()
    s = stratified_split(full, "SK_ID_CURR", "TARGET", 0.7)
    train, rest = s.where("split = 'train'").drop("split"), s.where("split = 'val'").drop("split")
    vocab = FI.fit_one_hot(train, CATS, 10)
    num = [c for c in full.columns if c not in CATS + ["SK_ID_CURR", "TARGET"]]
    med = FI.fit_medians(train, num)
    sc = FI.fit_scaler(FI.impute_median(FI.one_hot(train, vocab, CATS), num, med), num)

    def apply(df):
        return FI.standardize(FI.impute_median(FI.one_hot(df, vocab, CATS), num, med), sc)
    return apply(train), apply(rest)


@query("train_mart")
def q_train_mart(spark, d):
    return round_double_cols(train_score_marts(spark, d)[0])


@query("score_mart")
def q_score_mart(spark, d):
    return round_double_cols(train_score_marts(spark, d)[1])
