"""Hand-checked fixtures for the semantic traps (nulls, ties, zero
denominators, bin edges, degenerate drift inputs)."""

import math

import pytest
from pyspark.sql import functions as F

from riskframe.functions import exprs as X
from riskframe.operators import drift as DR
from riskframe.operators import features as FT
from riskframe.operators import metrics as M
from riskframe.operators.ordered import running_sum
from riskframe.operators.rollup import agg_spec


def test_risk_bands(spark):
    # probabilities and bands of the scoring-service tests
    rows = [(0.0, "LOW"), (0.15, "LOW"), (0.29, "LOW"), (0.35, "MEDIUM"), (0.49, "MEDIUM"), (0.65, "HIGH"), (1.0, "HIGH")]
    df = spark.createDataFrame(rows, "p double, want string")
    got = df.select(X.risk_band("p").alias("b"), "want").collect()
    assert all(r.b == r.want for r in got)


def test_safe_div_and_flags_null_semantics(spark):
    df = spark.createDataFrame([(1.0, 0.0), (None, 2.0), (3.0, None)], "a double, b double")
    r = df.select(X.safe_div("a", "b").alias("q"), X.flag(F.col("a") > 0).alias("f"),
                  X.clip_lower(F.col("a") - 2, 0.0).alias("c")).collect()
    assert r[0].q is None and r[1].q is None and r[2].q is None
    assert [x.f for x in r] == [1, 0, 1]
    assert r[1].c is None and r[0].c == 0.0


def test_bins_right_closed(spark):
    df = spark.createDataFrame([(0.0,), (25.0,), (25.5,), (100.0,), (100.5,)], "age double")
    got = [r.g for r in df.select(X.bins_right_closed("age", FT.AGE_BINS, FT.AGE_LABELS).alias("g")).collect()]
    assert got == [None, 1.0, 2.0, 5.0, None]


def test_row_stats(spark):
    df = spark.createDataFrame([(1.0, None, 3.0), (None, None, None), (2.0, None, None)], "a double, b double, c double")
    st = X.row_stats(["a", "b", "c"])
    r = df.select(*[v.alias(k) for k, v in st.items()]).collect()
    assert r[0]["mean"] == 2.0 and math.isclose(r[0]["std"], math.sqrt(2)) and r[0]["median"] == 2.0
    assert r[1]["mean"] is None and r[2]["std"] is None


def test_agg_spec_sum_of_missing_is_zero(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 5.0), (None, 1.0)], "k long, v double")
    out = {r.k: r for r in agg_spec(df, "k", "P", {"v": ["sum", "mean", "count"]}).collect()}
    assert set(out) == {1, 2}
    assert out[1].P_v_SUM == 0 and out[1].P_v_MEAN is None and out[1].P_v_COUNT == 0


def test_clean_names_collision(spark):
    df = spark.createDataFrame([(1, 2)], "`a b` int, `a/b` int")
    with pytest.raises(ValueError):
        FT.clean_names(df)
    assert FT.clean_name(" ext-price ($)") == "ext-price"


def test_running_sum_partition_invariance(spark):
    df = spark.range(0, 5000).select((F.col("id") % 997).alias("g"), (F.col("id") * 7 % 5003).cast("double").alias("o"),
                                     F.lit(1).alias("one"))
    a = running_sum(df, "o", ["one"], ["g"], ranges=8).orderBy("g", "o").collect()
    b = running_sum(df.repartition(1), "o", ["one"], ["g"], ranges=64).orderBy("g", "o").collect()
    assert [r.cum_one for r in a] == [r.cum_one for r in b]
    first = {}
    for r in a:
        first.setdefault(r.g, []).append(r.cum_one)
    assert all(v == list(range(1, len(v) + 1)) for v in first.values())


def test_auc_ties_and_constant_scores(spark):
    df = spark.createDataFrame([(1, 0.8), (0, 0.8), (1, 0.6), (0, 0.2)], "y int, s double")
    auc = M.roc_auc(df, "y", "s").first().roc_auc
    assert math.isclose(auc, 0.625)  # tie pair counts one half
    const = spark.createDataFrame([(1, 0.5), (0, 0.5), (0, 0.5)], "y int, s double")
    assert math.isclose(M.roc_auc(const, "y", "s").first().roc_auc, 0.5)


def test_ks_and_psi_identical_samples(spark):
    df = spark.range(0, 1000).select((F.col("id") % 37).cast("double").alias("x"))
    ks = DR.ks_drift(df, df, ["x"]).first()
    assert ks.ks_statistic == 0.0 and ks.p_value == 1.0
    assert abs(DR.psi(df, df, ["x"]).first().psi) < 1e-9
    shifted = df.select((F.col("x") + 5).alias("x"))
    assert DR.psi(df, shifted, ["x"]).first().psi > 0.1


def test_ks_empty_side(spark):
    a = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    b = spark.createDataFrame([(None,)], "x double")
    r = DR.ks_drift(a, b, ["x"]).first()
    assert r.ks_statistic == 0.0 and r.p_value == 1.0


def test_chi2_identical_categories(spark):
    df = spark.createDataFrame([(c,) for c in ["A", "B", "C"] * 30], "c string")
    r = DR.chi2_drift(df, df, ["c"]).first()
    assert r.chi2_statistic < 1 and r.p_value > 0.9


def test_chi2_sf_reference_values():
    import numpy as np
    # chi2 survival values: P(X > 3.841) with 1 dof ~= 0.05, P(X > 18.307) with 10 dof ~= 0.05
    q = DR._gammainc_upper(np.array([0.5, 5.0]), np.array([3.841459 / 2, 18.307038 / 2]))
    assert abs(q[0] - 0.05) < 1e-5 and abs(q[1] - 0.05) < 1e-5


def test_threshold_grid_is_exact(spark):
    df = spark.createDataFrame([(1, 0.29), (0, 0.3), (1, 0.01), (0, 0.99), (1, 1.0)], "y int, s double")
    sw = {round(r.threshold, 2): r for r in M.threshold_sweep(df, "y", "s").collect()}
    assert sw[0.3].tp + sw[0.3].fp == 3  # 0.3, 0.99, 1.0 (0.29 stays below)
    assert sw[0.01].tp + sw[0.01].fp == 5


def test_schema_set_checks(spark):
    from riskframe.operators import checks as C
    df = spark.createDataFrame([(1, 2.0, "x")], "a long, b double, c string")
    r = C.feature_set_match(df, ["a", "b", "d"]).first()
    assert r.missing == ["d"] and r.extra == ["c"] and not r.is_match
    cov = C.critical_coverage(df, ["a", "b", "c", "d", "e", "f", "g"], 0.85).first()
    assert cov.n_present == 3 and not cov.passes
    assert C.required_tables(spark, ["app", "bureau"], ["app", "bureau", "prev"]).first().missing_tables == ["prev"]


def test_exact_quantiles_match_percentile(spark):
    from riskframe.operators.ordered import exact_quantiles
    df = spark.createDataFrame([(g, float(v)) for g in ("a", "b") for v in ([1, 2, 3, 10] if g == "a" else [5, 5, 5, 7, 9])],
                               "g string, v double")
    got = {(r.g, r.p): r.quantile for r in exact_quantiles(df, "v", [0.25, 0.5, 1.0], ["g"]).collect()}
    assert got[("a", 0.25)] == 1.75 and got[("a", 0.5)] == 2.5 and got[("a", 1.0)] == 10.0
    assert got[("b", 0.5)] == 5.0 and got[("b", 0.25)] == 5.0


def test_hash_top_n_exact_under_skew(spark):
    from riskframe.operators.sample import hash_top_n
    # one hot group with most rows
    df = spark.range(0, 20000).select("id", F.when(F.col("id") < 15000, "hot").otherwise("cold").alias("g"))
    got = hash_top_n(df, "id", 50, ["g"]).groupBy("g").count().collect()
    assert {r.g: r["count"] for r in got} == {"hot": 50, "cold": 50}


@pytest.mark.parametrize("key", ["rollup_installments", "roc_auc", "strat_kfold", "outliers_iqr", "psi"])
def test_partition_count_invariance(spark, key):
    """Results do not depend on the number of shuffle partitions / ranges."""
    import __spark_entry__ as E
    sf = "/root/testdata/sf0.001"
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        a = sorted(map(tuple, E.queries()[key](spark, sf).collect()))
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        b = sorted(map(tuple, E.queries()[key](spark, sf).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b


def test_cv_run_fits_to_the_defaults(spark, monkeypatch):
    from riskframe.plans import q_model
    seen = {}
    monkeypatch.setattr(q_model.MD, "cross_validate", lambda *a, **kw: seen.update(kw) or (None, None))
    q_model._cv(spark, "/root/testdata/sf0.001")
    assert set(seen) == {"resample"}
