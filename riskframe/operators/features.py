"""Row-level feature blocks (projections only: no shuffle, all codegen).

Each block skips an output whose inputs are absent, like the reference
(``if col in df.columns``); column presence is a plan-time property so the
output schema is fixed before any data is read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.exprs import (bins_right_closed, clip, clip_lower, flag, missing_indicators,
                                       nan_null, row_stats, row_sum, safe_div, weighted_blend)

# fixed values: sentinel, denominators, cut points and weights of the feature definitions
EMPLOYED_SENTINEL = 365243
EPS = 1e-5
AGE_BINS = [0, 25, 35, 50, 65, 100]
AGE_LABELS = [1.0, 2.0, 3.0, 4.0, 5.0]
INCOME_BINS = [0, 100000, 200000, 300000, float("inf")]
INCOME_LABELS = [1.0, 2.0, 3.0, 4.0]
EXT_SOURCES = ["EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"]
EXT_WEIGHTS = {"EXT_SOURCE_1": 0.1, "EXT_SOURCE_2": 0.5, "EXT_SOURCE_3": 0.4}
MISSING_IMPORTANT = ["AMT_GOODS_PRICE", "AMT_ANNUITY", "CNT_FAM_MEMBERS", "DAYS_EMPLOYED", "OWN_CAR_AGE",
                     "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3", "OCCUPATION_TYPE", "ORGANIZATION_TYPE"]
TIME_COLS = ["DAYS_REGISTRATION", "DAYS_ID_PUBLISH", "DAYS_LAST_PHONE_CHANGE"]
RECENT_DAYS = -365
INTERACTIONS = [("EXT_SOURCE_2", "EXT_SOURCE_3"), ("AMT_CREDIT", "AMT_INCOME_TOTAL"),
                ("AMT_ANNUITY", "AMT_INCOME_TOTAL"), ("AGE_YEARS", "EMPLOYMENT_YEARS"),
                ("AMT_CREDIT", "AMT_GOODS_PRICE")]
PRODUCT_INTERACTIONS = [("AMT_INCOME_TOTAL", "AMT_CREDIT"), ("AMT_INCOME_TOTAL", "AMT_ANNUITY"),
                        ("EXT_SOURCE_1", "EXT_SOURCE_2"), ("EXT_SOURCE_2", "EXT_SOURCE_3"),
                        ("DAYS_BIRTH", "DAYS_EMPLOYED")]
POLY_PRIORITY = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE",
                 "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3",
                 "DAYS_BIRTH", "DAYS_EMPLOYED", "DAYS_ID_PUBLISH", "DAYS_REGISTRATION",
                 "BUREAU_DAYS_CREDIT_MEAN", "BUREAU_DAYS_CREDIT_UPDATE_MEAN",
                 "BUREAU_AMT_CREDIT_SUM_MEAN", "BUREAU_AMT_CREDIT_SUM_DEBT_MEAN"]
HIGH_BURDEN = 0.4
HIGH_LEVERAGE = 10
OLD_CAR = 10
NEW_CAR = 3


def _has(df: DataFrame, *cols: str) -> bool:
    return all(c in df.columns for c in cols)


def _sqrt0(c):
    """sqrt of a value clipped at 0 (negative -> 0, NULL stays NULL)."""
    return F.sqrt(clip_lower(c, 0.0))


def _log1p(c):
    """log1p with pandas' domain: NaN/-inf for x <= -1 become NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c > F.lit(-1.0), F.log1p(c))


def _sqrt(c):
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c >= F.lit(0.0), F.sqrt(c))


def sentinel_null(df: DataFrame, col: str = "DAYS_EMPLOYED", sentinel=EMPLOYED_SENTINEL) -> DataFrame:
    return df.withColumn(col, F.nullif(F.col(col), F.lit(sentinel)))


# ---------------------------------------------------------------- derived columns as a table

@dataclass(frozen=True)
class Feature:
    """``out`` = ``expr()`` where all ``needs`` are columns and no ``absent`` is."""
    out: str
    needs: tuple[str, ...]
    expr: Callable[[], Column]
    absent: tuple[str, ...] = ()


def derive(df: DataFrame, features: Iterable[Feature]) -> DataFrame:
    """Add every feature whose inputs are there (all from the columns of ``df``)."""
    have = set(df.columns)
    return df.withColumns({f.out: f.expr() for f in features if have.issuperset(f.needs) and have.isdisjoint(f.absent)})


def _years(c: str) -> Column:
    return -F.col(c).cast("double") / F.lit(365.0)


def _employed() -> Column:
    return F.nullif(F.col("DAYS_EMPLOYED"), F.lit(EMPLOYED_SENTINEL))


def _employment() -> Column:
    return clip_lower(-_employed().cast("double") / F.lit(365.0), 0.0)


def _ratio(out: str, a: str, b: str) -> Feature:
    return Feature(out, (a, b), lambda: safe_div(a, b, EPS))


def _square(out: str, a: str, b: str) -> Feature:
    return Feature(out, (a, b), lambda: F.pow(safe_div(a, b, EPS), 2))


def _above(out: str, a: str, b: str, limit: float) -> Feature:
    return Feature(out, (a, b), lambda: flag(safe_div(a, b, EPS) > limit))


def _of(out: str, c: str, fn: Callable[[Column], Column]) -> Feature:
    return Feature(out, (c,), lambda: fn(F.col(c)))


EMPLOYMENT = (Feature("DAYS_EMPLOYED", ("DAYS_EMPLOYED",), _employed), Feature("EMPLOYMENT_YEARS", ("DAYS_EMPLOYED",), _employment))

DOMAIN = (
    Feature("AGE_YEARS", ("DAYS_BIRTH",), lambda: _years("DAYS_BIRTH")),
    *EMPLOYMENT,
    Feature("IS_EMPLOYED", ("DAYS_EMPLOYED",), lambda: flag(_employment() > 0)),
    _ratio("INCOME_PER_PERSON", "AMT_INCOME_TOTAL", "CNT_FAM_MEMBERS"),
    _ratio("DEBT_TO_INCOME_RATIO", "AMT_CREDIT", "AMT_INCOME_TOTAL"),
    _ratio("CREDIT_TO_GOODS_RATIO", "AMT_CREDIT", "AMT_GOODS_PRICE"),
    _ratio("CREDIT_UTILIZATION", "AMT_CREDIT", "AMT_GOODS_PRICE"),
    _ratio("ANNUITY_TO_INCOME_RATIO", "AMT_ANNUITY", "AMT_INCOME_TOTAL"),
    _of("HAS_CHILDREN", "CNT_CHILDREN", lambda c: flag(c > 0)),
    _ratio("CHILDREN_RATIO", "CNT_CHILDREN", "CNT_FAM_MEMBERS"),
    Feature("REGION_RATING_COMBINED", ("REGION_RATING_CLIENT", "REGION_RATING_CLIENT_W_CITY"),
            lambda: (F.col("REGION_RATING_CLIENT") + F.col("REGION_RATING_CLIENT_W_CITY")) / F.lit(2.0)),
)

AGE = (
    Feature("AGE_YEARS", ("DAYS_BIRTH",), lambda: _years("DAYS_BIRTH")),
    Feature("AGE_GROUP", ("DAYS_BIRTH",), lambda: bins_right_closed(_years("DAYS_BIRTH"), AGE_BINS, AGE_LABELS)),
    Feature("AGE_SQUARED", ("DAYS_BIRTH",), lambda: F.pow(_years("DAYS_BIRTH"), 2)),
    Feature("AGE_LOG", ("DAYS_BIRTH",), lambda: _log1p(_years("DAYS_BIRTH"))),
)

TIME = (
    *EMPLOYMENT,
    Feature("EMPLOYMENT_TO_AGE_RATIO", ("DAYS_EMPLOYED", "AGE_YEARS"), lambda: clip(safe_div(_employment(), "AGE_YEARS", EPS), 0.0, 1.0)),
    *(Feature(f"{c}_YEARS", (c,), lambda c=c: _years(c)) for c in TIME_COLS),
    *(_of(f"{c}_IS_RECENT", c, lambda x: flag(x > F.lit(RECENT_DAYS))) for c in TIME_COLS),
    _of("CAR_AGE_SQUARED", "OWN_CAR_AGE", lambda c: F.pow(c, 2)),
    _of("HAS_OLD_CAR", "OWN_CAR_AGE", lambda c: flag(c > OLD_CAR)),
    _of("HAS_NEW_CAR", "OWN_CAR_AGE", lambda c: flag(c < NEW_CAR)),
)


def _down() -> Column:
    return F.col("AMT_GOODS_PRICE") - F.col("AMT_CREDIT")


CREDIT = (
    _ratio("PAYMENT_BURDEN", "AMT_ANNUITY", "AMT_INCOME_TOTAL"),
    _square("PAYMENT_BURDEN_SQUARED", "AMT_ANNUITY", "AMT_INCOME_TOTAL"),
    _above("HIGH_PAYMENT_BURDEN", "AMT_ANNUITY", "AMT_INCOME_TOTAL", HIGH_BURDEN),
    _of("AMT_CREDIT_LOG", "AMT_CREDIT", _log1p),
    _of("AMT_CREDIT_SQRT", "AMT_CREDIT", _sqrt),
    _ratio("CREDIT_TO_INCOME", "AMT_CREDIT", "AMT_INCOME_TOTAL"),
    _square("CREDIT_TO_INCOME_SQUARED", "AMT_CREDIT", "AMT_INCOME_TOTAL"),
    _above("HIGH_LEVERAGE", "AMT_CREDIT", "AMT_INCOME_TOTAL", HIGH_LEVERAGE),
    Feature("DOWN_PAYMENT", ("AMT_CREDIT", "AMT_GOODS_PRICE"), _down),
    Feature("DOWN_PAYMENT_RATE", ("AMT_CREDIT", "AMT_GOODS_PRICE"), lambda: clip(safe_div(_down(), "AMT_GOODS_PRICE", EPS), -1.0, 1.0)),
    Feature("IS_OVERFINANCED", ("AMT_CREDIT", "AMT_GOODS_PRICE"), lambda: flag(F.col("AMT_CREDIT") > F.col("AMT_GOODS_PRICE"))),
    _of("INCOME_LOG", "AMT_INCOME_TOTAL", _log1p),
    _of("INCOME_SQRT", "AMT_INCOME_TOTAL", _sqrt),
    _ratio("INCOME_PER_FAMILY_MEMBER", "AMT_INCOME_TOTAL", "CNT_FAM_MEMBERS"),
    Feature("INCOME_PER_FAMILY_MEMBER", ("AMT_INCOME_TOTAL",), lambda: safe_div("AMT_INCOME_TOTAL", F.lit(1), EPS), absent=("CNT_FAM_MEMBERS",)),
    _of("INCOME_GROUP", "AMT_INCOME_TOTAL", lambda c: bins_right_closed("AMT_INCOME_TOTAL", INCOME_BINS, INCOME_LABELS)),
)


def ext_table(ext: Sequence[str]) -> list[Feature]:
    """Pair terms, row statistics, the weighted blend and powers of the scores present."""
    pair = {"x": lambda a, b: F.col(a) * F.col(b), "div": lambda a, b: safe_div(a, b, EPS), "minus": lambda a, b: F.col(a) - F.col(b)}
    power = {"SQUARED": lambda c: F.pow(c, 2), "CUBED": lambda c: F.pow(c, 3), "SQRT": _sqrt0}
    stats = row_stats(ext) if ext else {}
    rows = [Feature(f"{a}_{op}_{b}", (a, b), lambda fn=fn, a=a, b=b: fn(a, b)) for op, fn in pair.items() for a, b in combinations(ext, 2)]
    rows += [Feature(f"EXT_SOURCE_{k.upper()}", (), lambda k=k: stats[k]) for k in ("mean", "std", "max", "min", "median", "range") if ext]
    rows += [Feature("EXT_SOURCE_WEIGHTED", ("EXT_SOURCE_2", "EXT_SOURCE_3"),
                     lambda: weighted_blend({(c if c in ext else None): w for c, w in EXT_WEIGHTS.items()}))]
    return rows + [_of(f"{c}_{name}", c, fn) for c in ext for name, fn in power.items()]


def _present(df: DataFrame) -> list[str]:
    return [c for c in EXT_SOURCES if c in df.columns]


def domain_features(df: DataFrame) -> DataFrame:
    """The 15-column domain block."""
    docs = [c for c in df.columns if c.startswith("FLAG_DOCUMENT_")]
    ext = _present(df)
    wide = [Feature("TOTAL_DOCUMENTS_PROVIDED", (), lambda: row_sum(docs))] if docs else []
    wide += [Feature(f"EXT_SOURCE_{k.upper()}", (), lambda k=k: row_stats(ext)[k]) for k in ("mean", "max", "min") if ext]
    return derive(df, [*DOMAIN, *wide])


def ext_source_features(df: DataFrame) -> DataFrame:
    return derive(df, ext_table(_present(df)))


def missing_value_features(df: DataFrame, cols: Sequence[str] = MISSING_IMPORTANT) -> DataFrame:
    avail = [c for c in cols if c in df.columns]
    if not avail:
        return df
    return df.withColumns(missing_indicators(avail))


def time_features(df: DataFrame) -> DataFrame:
    return derive(derive(df, AGE), TIME)


def credit_behaviour_features(df: DataFrame) -> DataFrame:
    return derive(df, CREDIT)


#: fixed values: output, words that a column's name must hold one of, smallest number of such columns, statistic
AGGREGATES = (
    ("BUREAU_CREDIT_MEAN", ("AMT_CREDIT",), 2, lambda c: row_stats(c)["mean"]),
    ("BUREAU_CREDIT_STD", ("AMT_CREDIT",), 2, lambda c: row_stats(c)["std"]),
    ("BUREAU_CREDIT_MAX", ("AMT_CREDIT",), 2, lambda c: row_stats(c)["max"]),
    ("BUREAU_AVG_CREDIT_AGE", ("DAYS_CREDIT",), 1, lambda c: row_stats(c)["mean"] / F.lit(-365.0)),
)
DEBT_WORDS = ("DEBT", "SUM")


def aggregate_column_features(df: DataFrame, prefix: str = "BUREAU_") -> DataFrame:
    """Row stats over aggregate columns picked by name at plan time."""
    named = lambda words: [c for c in df.columns if prefix in c and any(w in c for w in words)]
    debt = named(DEBT_WORDS)
    rows = [Feature("BUREAU_TOTAL_DEBT", (), lambda: row_sum(debt)),
            Feature("BUREAU_DEBT_TO_INCOME", ("AMT_INCOME_TOTAL",), lambda: safe_div(row_sum(debt), "AMT_INCOME_TOTAL", EPS))] if debt else []
    rows += [Feature(out, (), lambda c=named(words), fn=fn: fn(c)) for out, words, least, fn in AGGREGATES if len(named(words)) >= least]
    return derive(df, rows)


def interaction_features(df: DataFrame, pairs=INTERACTIONS) -> DataFrame:
    new = {}
    for a, b in pairs:
        if _has(df, a, b):
            new[f"{a}_x_{b}_INT"] = F.col(a) * F.col(b)
            new[f"{a}_div_{b}_INT"] = safe_div(a, b, EPS)
            new[f"{a}_plus_{b}_INT"] = F.col(a) + F.col(b)
    return df.withColumns(new)


def product_interactions(df: DataFrame, pairs=PRODUCT_INTERACTIONS) -> DataFrame:
    return df.withColumns({f"INTERACT_{a}_x_{b}": F.col(a) * F.col(b) for a, b in pairs if _has(df, a, b)})


def advanced_features(df: DataFrame) -> DataFrame:
    """All advanced blocks in order (ext sources, missing, time, credit,
    aggregate-column stats, interactions)."""
    for block in (ext_source_features, missing_value_features, time_features,
                  credit_behaviour_features, aggregate_column_features, interaction_features):
        df = block(df)
    return df


def nan_to_null_cols(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: nan_null(c) for c in cols})


# ---------------------------------------------------------------- column names

_BAD = re.compile(r"[^A-Za-z0-9_-]")


def clean_name(name: str) -> str:
    """Non ``[A-Za-z0-9_-]`` -> '_', runs of '_' squeezed, ends stripped."""
    s = _BAD.sub("_", name)
    s = re.sub(r"_+", "_", s)
    return s.strip("_")


def clean_names(df: DataFrame) -> DataFrame:
    """Rename columns to clean names; two columns colliding is an error."""
    new = [clean_name(c) for c in df.columns]
    seen = {}
    for old, n in zip(df.columns, new):
        if n in seen:
            raise ValueError(f"column names {seen[n]!r} and {old!r} both clean to {n!r}")
        seen[n] = old
    return df.toDF(*new)


# ---------------------------------------------------------------- polynomial

NUMERIC = ("int", "bigint", "smallint", "tinyint", "double", "float")


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if f.dataType.simpleString() in NUMERIC or f.dataType.simpleString().startswith("decimal")
            if f.name not in exclude]


def pick_poly_columns(df: DataFrame, max_features: int = 15, priority: Sequence[str] = POLY_PRIORITY,
                      exclude: Sequence[str] = ()) -> list[str]:
    """Priority names present first, then the highest sample variance numeric
    columns.  Variances come from ONE aggregate (one row per column)."""
    chosen = [c for c in priority if c in df.columns][:max_features]
    if len(chosen) < max_features:
        cand = [c for c in numeric_columns(df, exclude) if c not in chosen]
        if cand:
            row = df.agg(*[F.var_samp(F.col(c).cast("double")).alias(c) for c in cand]).first()
            ranked = sorted(cand, key=lambda c: (-(row[c] if row[c] is not None else float("-inf")),
                                                 cand.index(c)))
            chosen += ranked[:max_features - len(chosen)]
    return chosen


def fit_medians(df: DataFrame, cols: Sequence[str]) -> dict:
    """Exact median per column in one aggregate (state: one value per column)."""
    from riskframe.operators.fit import fit_medians as _fit
    return _fit(df, cols)


def poly_features(df: DataFrame, cols: Sequence[str], degree: int = 2, interaction_only: bool = False,
                  medians: dict | None = None) -> DataFrame:
    """Degree-d expansion of median-filled columns, degree-1 terms dropped,
    names ``POLY_a_pow_2`` / ``POLY_a_x_b``."""
    med = medians if medians is not None else fit_medians(df, cols)
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(med[c])) for c in cols}
    terms = poly_terms_of(filled, list(cols), degree, interaction_only)
    return df.withColumns(terms)


def poly_terms_of(filled: dict, cols: list[str], degree: int, interaction_only: bool) -> dict:
    import itertools
    out = {}
    for d in range(2, degree + 1):
        combos = (itertools.combinations(cols, d) if interaction_only
                  else itertools.combinations_with_replacement(cols, d))
        for combo in combos:
            counts: dict = {}
            for c in combo:
                counts[c] = counts.get(c, 0) + 1
            name = "_x_".join(c if k == 1 else f"{c}_pow_{k}" for c, k in counts.items())
            term = None
            for c in combo:
                term = filled[c] if term is None else term * filled[c]
            out["POLY_" + name] = term
    return out


# fixed values: feature strategies of the experiment grid
FEATURE_STRATEGIES = ("baseline", "domain", "polynomial", "combined")


def feature_strategy(df: DataFrame, name: str, poly_cols: Sequence[str] | None = None) -> DataFrame:
    """Dispatch a feature strategy: raw columns, + domain block, + degree-2
    polynomial terms, or both."""
    if name not in FEATURE_STRATEGIES:
        raise ValueError(f"unknown feature strategy {name!r}")
    out = df
    if name in ("domain", "combined"):
        out = domain_features(out)
    if name in ("polynomial", "combined"):
        cols = list(poly_cols or pick_poly_columns(df, 5, exclude=["SK_ID_CURR", "TARGET"]))
        out = poly_features(out, cols, 2)
    return out
