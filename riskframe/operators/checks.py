"""Validators and profiles.  Each returns a small report DataFrame computed by
one (or a few) distributed aggregates; ``*_or_fail`` variants raise.

Wide per-column profiles use ONE aggregate over all columns and then stack the
single result row (rows = number of columns, known at plan time).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


class DataValidationError(ValueError):
    pass


def is_numeric(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, NUMERIC_TYPES)


def stack_row(wide: DataFrame, items: Sequence[tuple[str, Sequence[str]]], names: Sequence[str]) -> DataFrame:
    """Turn a 1-row wide aggregate into one row per item.

    ``items`` = [(label, [col_of_wide for each output name])]."""
    structs = [F.struct(F.lit(label).alias("feature"),
                        *[F.col(c).alias(n) for c, n in zip(cols, names)]) for label, cols in items]
    return wide.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


# ---------------------------------------------------------------- schema

def schema_report(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Missing / extra columns and match percentage as a one-row table."""
    have = set(df.columns)
    missing = sorted(set(expected) - have)
    extra = sorted(have - set(expected))
    pct = 100.0 * (len(expected) - len(missing)) / len(expected) if expected else 100.0
    spark = df.sparkSession
    return spark.createDataFrame(
        [(len(expected), len(df.columns), missing, extra, float(pct), not missing)],
        "n_expected long, n_actual long, missing array<string>, extra array<string>, match_pct double, "
        "is_match boolean")


def validate_schema(df: DataFrame, required: Sequence[str], optional: Sequence[str] = ()) -> DataFrame:
    """Required columns present (error) / optional present (warning) / empty table."""
    missing = [c for c in required if c not in df.columns]
    missing_opt = [c for c in optional if c not in df.columns]
    empty = df.isEmpty()
    return df.sparkSession.createDataFrame(
        [(missing, missing_opt, empty, not missing and not empty)],
        "missing_required array<string>, missing_optional array<string>, is_empty boolean, is_valid boolean")


# ---------------------------------------------------------------- ids / target / probabilities

def validate_ids(df: DataFrame, id_col: str, k: int = 5) -> DataFrame:
    """Null count, duplicate count (rows beyond each id's first) and the k
    smallest duplicated ids.  The sample is a bounded top-k, never a collect
    of all duplicates."""
    counts = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
    summary = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col(id_col).isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))
    sample = (counts.where((F.col("n") > 1) & F.col(id_col).isNotNull())
              .orderBy(id_col).limit(k)
              .agg(F.sort_array(F.collect_list(id_col)).alias("first_duplicates")))
    return summary.crossJoin(sample).withColumn(
        "is_valid", (F.col("n_null") == 0) & (F.col("n_duplicates") == 0))


def validate_target(df: DataFrame, target: str, allowed: Sequence = (0, 1)) -> DataFrame:
    t = F.col(target)
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.count_if(t.isNull()).alias("n_null"),
            F.count_if(t.isNotNull() & ~t.isin(*allowed)).alias("n_invalid")]
    aggs += [F.count_if(t == F.lit(v)).alias(f"n_class_{v}") for v in allowed]
    out = df.agg(*aggs)
    return out.withColumn("is_valid", (F.col("n_null") == 0) & (F.col("n_invalid") == 0) & (F.col("n_rows") > 0))


def validate_proba(df: DataFrame, col: str) -> DataFrame:
    p = F.col(col).cast("double")
    finite = ~F.isnan(p) & (F.abs(p) != F.lit(float("inf")))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.isnan(p)).alias("n_nan"),
        F.count_if(F.abs(p) == F.lit(float("inf"))).alias("n_inf"),
        F.count_if(finite & ((p < 0) | (p > 1))).alias("n_out_of_range"),
        F.min(F.when(finite, p)).alias("min_value"),
        F.max(F.when(finite, p)).alias("max_value"),
    ).withColumn("is_valid", (F.col("n_nan") + F.col("n_inf") + F.col("n_out_of_range") == 0)
                 & (F.col("n_rows") > 0))


def finite_guard(df: DataFrame, key: str, vec: str, expected_len: int) -> DataFrame:
    """Per-row vector guard: NaN / Inf count and length check (no explode)."""
    v = F.col(vec)
    bad = F.size(F.filter(v, lambda x: F.isnan(x) | (F.abs(x) == F.lit(float("inf"))) | x.isNull()))
    return df.select(key, F.size(v).alias("n_values"), bad.alias("n_non_finite"),
                     ((F.size(v) == expected_len) & (bad == 0)).alias("is_valid"))


# ---------------------------------------------------------------- profiles

def constant_features(df: DataFrame, cols: Sequence[str], top_freq: float = 0.99,
                      std_eps: float = 1e-10) -> DataFrame:
    """Numeric: sample std < eps; categorical: most frequent value share >= top_freq.

    Numeric stds come from one aggregate; categorical shares from one
    (feature, value) count aggregate over the unpivoted strings."""
    num = [c for c in cols if is_numeric(df, c)]
    cat = [c for c in cols if c not in num]
    parts = []
    if num:
        wide = df.agg(*[F.stddev_samp(F.col(c).cast("double")).alias(c) for c in num])
        st = stack_row(wide, [(c, [c]) for c in num], ["stat"])
        parts.append(st.select("feature", F.lit("numeric").alias("kind"), "stat",
                               F.coalesce(F.col("stat") < F.lit(std_eps), F.lit(True)).alias("is_constant")))
    if cat:
        long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value"))
                                             for c in cat])).alias("s")).select("s.*")
        vc = long.where(F.col("value").isNotNull()).groupBy("feature", "value").count()
        share = vc.groupBy("feature").agg((F.max("count") / F.sum("count")).alias("stat"))
        parts.append(share.select("feature", F.lit("categorical").alias("kind"), "stat",
                                  (F.col("stat") >= F.lit(top_freq)).alias("is_constant")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def missing_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Missing count / percent / severity band per column (one aggregate)."""
    cols = list(cols or df.columns)
    wide = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in cols])
    st = stack_row(wide, [(c, [c, "__n"]) for c in cols], ["missing_count", "n_rows"])
    pct = F.col("missing_count") * F.lit(100.0) / F.col("n_rows")
    return st.select("feature", "missing_count", pct.alias("missing_pct"),
                     F.when(pct > 50, "HIGH").when(pct > 20, "MEDIUM").otherwise("LOW").alias("severity"))


def missing_rate(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    prof = missing_profile(df, cols)
    return prof.select("feature", F.bround("missing_pct", 2).alias("missing_rate"))


def quality_summary(df: DataFrame) -> DataFrame:
    """rows, columns, overall missing %, numeric / other column counts, duplicate rows."""
    cols = df.columns
    n_num = sum(1 for c in cols if is_numeric(df, c))
    miss = None
    for c in cols:
        t = F.count_if(F.col(f"`{c}`").isNull())
        miss = t if miss is None else miss + t
    base = df.agg(F.count(F.lit(1)).alias("n_rows"), miss.alias("n_missing_cells"))
    n_distinct = df.distinct().agg(F.count(F.lit(1)).alias("n_distinct_rows"))
    return base.crossJoin(n_distinct).select(
        "n_rows", F.lit(len(cols)).cast("bigint").alias("n_cols"), "n_missing_cells",
        F.try_divide(F.col("n_missing_cells") * F.lit(100.0), F.col("n_rows") * F.lit(len(cols))).alias("missing_pct"),
        F.lit(n_num).cast("bigint").alias("n_numeric_cols"), F.lit(len(cols) - n_num).cast("bigint").alias("n_other_cols"),
        (F.col("n_rows") - F.col("n_distinct_rows")).alias("n_duplicate_rows"))


def quality_report(df: DataFrame, target: str | None = None, max_card: int = 50,
                   min_class_share: float = 0.01) -> DataFrame:
    """(check, column, value) rows: duplicate rows, constant columns (nunique <= 1),
    infinite cells, minority class share below 1 %, high-cardinality strings."""
    cols = df.columns
    num = [c for c in cols if is_numeric(df, c)]
    aggs = [F.count(F.lit(1)).alias("__n")]
    # constant: at most one distinct value, i.e. min = max or nothing but nulls; one
    # pass without distinct counting
    simple = [c for c, t in df.dtypes if not t.startswith(("map", "array", "struct", "variant"))]
    aggs += [F.coalesce((F.min(F.col(f"`{c}`")) < F.max(F.col(f"`{c}`"))).cast("int") + 1, F.count(F.col(f"`{c}`")) * 0).alias(f"nu__{c}")
             if c in simple else F.countDistinct(F.col(f"`{c}`")).alias(f"nu__{c}") for c in cols]
    aggs += [F.count_if(F.abs(F.col(f"`{c}`").cast("double")) == F.lit(float("inf"))).alias(f"inf__{c}") for c in num]
    wide = df.agg(*aggs)
    items = [(c, [f"nu__{c}"]) for c in cols]
    nu = stack_row(wide, items, ["value"]).select(F.lit("n_unique").alias("check"), F.col("feature").alias("column"),
                                                  F.col("value").cast("double").alias("value"))
    out = nu.where(F.col("value") <= 1).withColumn("check", F.lit("constant"))
    hc = [c for c in cols if c not in num]
    if hc:
        # exact distinct counts of the string columns only: (column, value) pairs, combined map-side
        pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")) for c in hc])).alias("s"))
        card = pairs.select("s.*").where(F.col("v").isNotNull()).distinct().groupBy("column").agg(F.count(F.lit(1)).cast("double").alias("value"))
        out = out.unionByName(card.where(F.col("value") > max_card).select(F.lit("high_cardinality").alias("check"), "column", "value"))
    if num:
        inf = stack_row(wide, [(c, [f"inf__{c}"]) for c in num], ["value"]).select(
            F.lit("infinite").alias("check"), F.col("feature").alias("column"), F.col("value").cast("double").alias("value"))
        out = out.unionByName(inf.where(F.col("value") > 0))
    dup = df.groupBy(*[F.col(f"`{c}`") for c in cols]).count().agg(
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("double").alias("value")).select(
        F.lit("duplicate_rows").alias("check"), F.lit(None).cast("string").alias("column"), "value")
    out = out.unionByName(dup)
    if target:
        counts = df.groupBy(target).count()
        total = counts.agg(F.sum("count").alias("__total"))
        share = counts.crossJoin(total).select(
            F.lit("rare_class").alias("check"), F.col(target).cast("string").alias("column"),
            (F.col("count") / F.col("__total")).alias("value"))
        out = out.unionByName(share.where(F.col("value") < min_class_share))
    return out


# ---------------------------------------------------------------- ranges / outliers

def unpivot(df: DataFrame, ids: Sequence[str], cols: Sequence[str], var: str = "feature",
            val: str = "value") -> DataFrame:
    """Long form (ids..., feature, value) with values cast to double."""
    return df.select(*ids, F.explode(F.array(*[
        F.struct(F.lit(c).alias(var), F.col(c).cast("double").alias(val)) for c in cols])).alias("__s")
    ).select(*ids, f"__s.{var}", f"__s.{val}")


def out_of_range(reference: DataFrame, current: DataFrame, cols: Sequence[str],
                 bounds: Mapping[str, tuple] | None = None, max_pct: float = 5.0) -> DataFrame:
    """Per feature: current non-null values outside [min, max] of the reference
    (or of fixed ``bounds``); percent of non-null; status OK if below max_pct."""
    if bounds:
        lim = reference.sparkSession.createDataFrame(
            [(c, float(bounds[c][0]), float(bounds[c][1])) for c in cols], "feature string, lo double, hi double")
    else:
        wide = reference.agg(*[F.min(F.col(c).cast("double")).alias(f"lo__{c}") for c in cols],
                             *[F.max(F.col(c).cast("double")).alias(f"hi__{c}") for c in cols])
        lim = stack_row(wide, [(c, [f"lo__{c}", f"hi__{c}"]) for c in cols], ["lo", "hi"])
    cur = unpivot(current, [], cols).where(F.col("value").isNotNull())
    # lim has one row per feature (schema-bounded): broadcast is safe
    j = cur.join(F.broadcast(lim), "feature")
    out = j.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_values"),
        F.count_if((F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi"))).alias("n_out_of_range"))
    pct = F.col("n_out_of_range") * F.lit(100.0) / F.col("n_values")
    return out.select("feature", "n_values", "n_out_of_range", pct.alias("pct_out_of_range"),
                      F.when(pct < max_pct, "OK").otherwise("WARNING").alias("status"))


def range_rules(df: DataFrame, rules: Mapping[str, tuple], key: str) -> DataFrame:
    """Every rule violated: feature, count, smallest violating key as example."""
    present = [c for c in rules if c in df.columns]
    aggs = []
    for c in present:
        lo, hi = rules[c]
        bad = (F.col(c) < F.lit(lo)) | (F.col(c) > F.lit(hi))
        aggs += [F.count_if(bad).alias(f"n__{c}"), F.min(F.when(bad, F.col(key))).alias(f"ex__{c}"),
                 F.min(F.when(bad, F.col(c).cast("double"))).alias(f"v__{c}")]
    wide = df.agg(*aggs)
    st = stack_row(wide, [(c, [f"n__{c}", f"ex__{c}", f"v__{c}"]) for c in present],
                   ["n_violations", "example_key", "example_value"])
    lim = df.sparkSession.createDataFrame([(c, float(rules[c][0]), float(rules[c][1])) for c in present],
                                          "feature string, rule_min double, rule_max double")
    return st.join(F.broadcast(lim), "feature").where(F.col("n_violations") > 0)


def outliers_iqr(df: DataFrame, cols: Sequence[str], k: float = 1.5) -> DataFrame:
    """Q1 - k IQR .. Q3 + k IQR per feature (exact quantiles), count and % of all rows."""
    from riskframe.operators.ordered import column_quantiles
    qs = column_quantiles(df, cols, [0.25, 0.75]).groupBy("feature").agg(
        F.max(F.when(F.col("p_index") == 0, F.col("quantile"))).alias("q1"),
        F.max(F.when(F.col("p_index") == 1, F.col("quantile"))).alias("q3"))
    q = qs.crossJoin(df.agg(F.count(F.lit(1)).alias("n_rows")))
    q = q.withColumn("lower", F.col("q1") - F.lit(k) * (F.col("q3") - F.col("q1"))) \
         .withColumn("upper", F.col("q3") + F.lit(k) * (F.col("q3") - F.col("q1")))
    long = unpivot(df, [], cols)
    cnt = long.join(F.broadcast(q.select("feature", "lower", "upper")), "feature").groupBy("feature").agg(
        F.count_if((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))).alias("n_outliers"))
    return q.join(cnt, "feature", "left").select(
        "feature", "q1", "q3", "lower", "upper", F.coalesce("n_outliers", F.lit(0)).alias("n_outliers"),
        (F.coalesce("n_outliers", F.lit(0)) * F.lit(100.0) / F.col("n_rows")).alias("pct_outliers"))


def outliers_z(df: DataFrame, cols: Sequence[str], threshold: float = 3.0) -> DataFrame:
    wide = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m__{c}") for c in cols],
                  *[F.stddev_samp(F.col(c).cast("double")).alias(f"s__{c}") for c in cols])
    st = stack_row(wide, [(c, [f"m__{c}", f"s__{c}"]) for c in cols], ["mean", "std"])
    long = unpivot(df, [], cols)
    z = F.abs(F.try_divide(F.col("value") - F.col("mean"), F.col("std")))
    return long.join(F.broadcast(st), "feature").groupBy("feature").agg(
        F.first("mean").alias("mean"), F.first("std").alias("std"),
        F.count_if(z > F.lit(threshold)).alias("n_outliers"))


# ---------------------------------------------------------------- referential

def orphan_ids(parent: DataFrame, parent_key: str, children: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Per child table: distinct foreign keys with no parent row (anti join)."""
    parts = []
    p = parent.select(F.col(parent_key).alias("__k")).distinct()
    for name, (child, fk) in children.items():
        ck = child.select(F.col(fk).alias("__k")).where(F.col("__k").isNotNull()).distinct()
        orphans = ck.join(p, "__k", "left_anti")
        parts.append(ck.agg(F.count(F.lit(1)).alias("n_child_ids")).crossJoin(
            orphans.agg(F.count(F.lit(1)).alias("n_orphan_ids"))).select(F.lit(name).alias("table"), "*"))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def id_overlap(a: DataFrame, b: DataFrame, key: str, k: int = 5) -> DataFrame:
    """Ids present in both (leakage check): count and k smallest."""
    both = a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi")
    return both.agg(F.count(F.lit(1)).alias("n_overlap")).crossJoin(
        both.orderBy(key).limit(k).agg(F.sort_array(F.collect_list(key)).alias("first_overlap")))


def table_summary(tables: Mapping[str, tuple[DataFrame, str | None]]) -> DataFrame:
    parts = []
    for name, (df, idc) in tables.items():
        aggs = [F.count(F.lit(1)).alias("n_rows")]
        aggs.append(F.countDistinct(idc).alias("n_distinct_ids") if idc and idc in df.columns
                    else F.lit(None).cast("bigint").alias("n_distinct_ids"))
        parts.append(df.agg(*aggs).select(F.lit(name).alias("table"), "n_rows",
                                          F.lit(len(df.columns)).cast("bigint").alias("n_cols"),
                                          F.lit(bool(idc and idc in df.columns)).alias("has_id"), "n_distinct_ids"))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def id_presence(ids: DataFrame, key: str, tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """For an id set: how many are found in each table (semi join per table)."""
    want = ids.select(F.col(key).alias("__k")).where(F.col("__k").isNotNull()).distinct()
    n = want.agg(F.count(F.lit(1)).alias("n_ids"))
    parts = []
    for name, (df, col) in tables.items():
        found = want.join(df.select(F.col(col).alias("__k")), "__k", "left_semi")
        parts.append(found.agg(F.count(F.lit(1)).alias("n_found")).crossJoin(n).select(
            F.lit(name).alias("table"), "n_found", "n_ids", (F.col("n_ids") - F.col("n_found")).alias("n_missing")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def align_features(df: DataFrame, expected: Sequence[str], keys: Sequence[str] = (), fill=0.0) -> DataFrame:
    """Add missing expected columns as ``fill``, drop extras, fixed order."""
    return df.select(*keys, *[F.col(c) if c in df.columns else F.lit(fill).alias(c) for c in expected])


def drop_sparse(train: DataFrame, apply_to: DataFrame, max_missing: float = 0.70) -> DataFrame:
    """Drop columns whose missing share in ``train`` exceeds max_missing.

    The fitted state is one share per column (one aggregate)."""
    row = train.agg(*[F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(c) for c in train.columns]).first()
    keep = [c for c in apply_to.columns if c not in row or (row[c] or 0.0) <= max_missing]
    return apply_to.select(*keep)


def quality_gate(df: DataFrame, expected: Sequence[str], max_missing_pct: float = 20.0) -> DataFrame:
    """Invalid if any column exceeds max_missing_pct missing or the schema differs."""
    prof = missing_profile(df, [c for c in expected if c in df.columns])
    missing_cols = sorted(set(expected) - set(df.columns))
    bad = prof.where(F.col("missing_pct") > max_missing_pct)
    agg = bad.agg(F.count(F.lit(1)).alias("n_bad_columns"),
                  F.sort_array(F.collect_list("feature")).alias("bad_columns"))
    ok = (F.col("n_bad_columns") == 0) & F.lit(not missing_cols)
    return agg.select(
        "n_bad_columns", "bad_columns", F.lit(len(missing_cols)).cast("bigint").alias("n_missing_columns"),
        ok.alias("is_valid"),
        F.concat_ws("; ", F.when(~ok, F.lit("INVALID")).otherwise(F.lit("VALID")),
                    F.format_string("%d columns above %.0f%% missing", F.col("n_bad_columns"), F.lit(max_missing_pct)),
                    F.lit(f"{len(missing_cols)} expected columns absent")).alias("summary"))


# ---------------------------------------------------------------- set logic on schemas

def _one_row(spark, row: tuple, ddl: str) -> DataFrame:
    return spark.createDataFrame([row], ddl)


def feature_set_match(df: DataFrame, expected: Sequence[str], exact: bool = True) -> DataFrame:
    """Missing and extra feature names; ``exact`` also requires no extras."""
    have = list(df.columns)
    missing = [c for c in expected if c not in have]
    extra = [c for c in have if c not in expected]
    ok = not missing and (not extra or not exact)
    return _one_row(df.sparkSession, (missing, extra, ok),
                    "missing array<string>, extra array<string>, is_match boolean")


def critical_coverage(df: DataFrame, critical: Sequence[str], threshold: float = 0.85) -> DataFrame:
    """Share of critical columns present; passes at >= threshold."""
    present = [c for c in critical if c in df.columns]
    share = len(present) / len(critical) if critical else 1.0
    return _one_row(df.sparkSession, (len(present), len(critical), float(share), share >= threshold,
                                      [c for c in critical if c not in df.columns]),
                    "n_present long, n_critical long, coverage double, passes boolean, absent array<string>")


def required_tables(spark, provided: Sequence[str], required: Sequence[str]) -> DataFrame:
    missing = sorted(set(required) - set(provided))
    return _one_row(spark, (missing, not missing), "missing_tables array<string>, complete boolean")


def column_overlap(current: DataFrame, reference: DataFrame) -> DataFrame:
    cur, ref = set(current.columns), set(reference.columns)
    return _one_row(current.sparkSession, (sorted(cur & ref), sorted(cur - ref), sorted(ref - cur)),
                    "shared array<string>, only_current array<string>, only_reference array<string>")
