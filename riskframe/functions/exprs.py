"""Column builders: row-local feature expressions.

All of them are pure Catalyst expressions (no Python UDF), so they stay
inside whole-stage codegen and never cause a shuffle.  Null semantics follow
pandas where the reference relies on them (see README, "null rules").
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "col_of", "safe_div", "nan_null", "clip_lower", "clip", "flag", "row_sum",
    "row_stats", "bins_right_closed", "days_to_years", "weighted_blend",
    "pairwise_terms", "poly_terms", "missing_indicators", "hash_unit", "hash_bigint",
    "pseudonym", "risk_band", "decision", "round6", "finite_or_null",
]


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_null(c) -> Column:
    """NaN -> NULL (pandas 'missing')."""
    c = col_of(c)
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def finite_or_null(c) -> Column:
    """NaN and +-Inf -> NULL (JSON-safe numbers)."""
    c = col_of(c)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c)


def safe_div(a, b, plus: float = 0.0) -> Column:
    """a / (b + plus); a zero denominator gives NULL instead of an ANSI error."""
    den = col_of(b) + F.lit(plus) if plus else col_of(b)
    return F.try_divide(col_of(a).cast("double"), den.cast("double"))


def clip_lower(c, lower: float = 0.0) -> Column:
    """pandas ``clip(lower=...)``: NULL stays NULL (unlike ``greatest``)."""
    c = col_of(c)
    return F.when(c < F.lit(lower), F.lit(lower)).otherwise(c)


def clip(c, lower: float | None = None, upper: float | None = None) -> Column:
    c = col_of(c)
    if lower is not None:
        c = F.when(c < F.lit(lower), F.lit(lower)).otherwise(c)
    if upper is not None:
        c = F.when(c > F.lit(upper), F.lit(upper)).otherwise(c)
    return c


def flag(cond: Column) -> Column:
    """Boolean -> 0/1 int where a NULL comparison counts as 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def row_sum(cols: Iterable) -> Column:
    """Row-wise sum that skips nulls (all-null row -> 0, like pandas)."""
    cols = [F.coalesce(col_of(c).cast("double"), F.lit(0.0)) for c in cols]
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out


def row_stats(cols: Sequence) -> dict[str, Column]:
    """Row-wise mean / sample std / min / max / median / range, nulls skipped.

    Built from one compacted array per row; higher-order functions keep it
    inside codegen.  A row with no values yields NULL everywhere; one value
    gives a NULL std (ddof 1).
    """
    arr = F.array_compact(F.array(*[col_of(c).cast("double") for c in cols]))
    n = F.size(arr)
    total = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)
    mean = F.when(n > 0, total / n)
    ss = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
    std = F.when(n > 1, F.sqrt(ss / (n - 1)))
    srt = F.array_sort(arr)
    mid = F.floor(n / 2).cast("int")
    median = F.when(n == 0, F.lit(None)).when(
        n % 2 == 1, F.element_at(srt, mid + 1)).otherwise(
        (F.element_at(srt, F.greatest(mid, F.lit(1))) + F.element_at(srt, mid + 1)) / 2)
    mx = F.array_max(arr)
    mn = F.array_min(arr)
    return {"mean": mean, "std": std, "max": mx, "min": mn, "median": median,
            "range": mx - mn}


def bins_right_closed(c, edges: Sequence[float], labels: Sequence | None = None) -> Column:
    """``pd.cut`` semantics: (e0,e1], (e1,e2], ...; outside -> NULL.

    Returns the bin index (0-based, as double like ``.astype(float)``) or the
    given label.
    """
    c = col_of(c)
    labels = list(labels) if labels is not None else [float(i) for i in range(len(edges) - 1)]
    out = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (c > F.lit(lo)) & (c <= F.lit(hi))
        out = F.when(cond, F.lit(lab)) if out is None else out.when(cond, F.lit(lab))
    return out


def days_to_years(c) -> Column:
    """-days / 365 clipped at 0 (NULL stays NULL)."""
    return clip_lower(-col_of(c).cast("double") / F.lit(365.0), 0.0)


def weighted_blend(weights: dict) -> Column:
    """sum(w_i * x_i); an absent column is passed as None and contributes 0."""
    out = F.lit(0.0)
    for c, w in weights.items():
        if c is not None:
            out = out + F.lit(float(w)) * col_of(c)
    return out


def pairwise_terms(cols: Sequence[str], ops=("x", "div", "minus")) -> dict[str, Column]:
    """Products / guarded ratios / differences over all pairs i<j."""
    out = {}
    for a, b in itertools.combinations(cols, 2):
        if "x" in ops:
            out[f"{a}_x_{b}"] = F.col(a) * F.col(b)
        if "div" in ops:
            out[f"{a}_div_{b}"] = safe_div(a, b, 1e-5)
        if "minus" in ops:
            out[f"{a}_minus_{b}"] = F.col(a) - F.col(b)
    return out


def poly_terms(cols: Sequence[str], degree: int = 2, interaction_only: bool = False,
               prefix: str = "POLY_") -> dict[str, Column]:
    """Polynomial expansion without bias, degree 1..d, named like
    ``POLY_a``, ``POLY_a^2``, ``POLY_a b``."""
    out = {}
    for d in range(1, degree + 1):
        combos = (itertools.combinations(cols, d) if interaction_only
                  else itertools.combinations_with_replacement(cols, d))
        for combo in combos:
            counts = {}
            for c in combo:
                counts[c] = counts.get(c, 0) + 1
            name = " ".join(c if k == 1 else f"{c}^{k}" for c, k in counts.items())
            term = None
            for c in combo:
                term = F.col(c) if term is None else term * F.col(c)
            out[prefix + name] = term
    return out


def missing_indicators(cols: Sequence[str], suffix: str = "_IS_MISSING") -> dict[str, Column]:
    out = {f"{c}{suffix}": F.col(c).isNull().cast("int") for c in cols}
    total = None
    for c in cols:
        t = F.col(c).isNull().cast("int")
        total = t if total is None else total + t
    out["TOTAL_MISSING_COUNT"] = total
    out["MISSING_RATE"] = total.cast("double") / F.lit(float(len(cols)))
    return out


def hash_bigint(*parts, seed: int | str = 42) -> Column:
    """Portable 32-bit hash: first 8 hex digits of md5(p1_p2_..._seed) as bigint.

    DuckDB twin: ``CAST(('0x' || substr(md5(...), 1, 8)) AS BIGINT)``.
    Depends only on the row's values, never on partitioning.
    """
    s = F.concat_ws("_", *[col_of(p).cast("string") for p in parts], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint")


def hash_unit(*parts, seed: int | str = 42) -> Column:
    """hash_bigint scaled to [0, 1)."""
    return hash_bigint(*parts, seed=seed).cast("double") / F.lit(4294967296.0)


def pseudonym(c, salt: str, space: int = 900000, offset: int = 100000) -> Column:
    """int(sha256(str(id) + salt)[:8], 16) % space + offset."""
    h = F.conv(F.substring(F.sha2(F.concat(col_of(c).cast("string"), F.lit(salt)), 256), 1, 8), 16, 10)
    return (F.pmod(h.cast("bigint"), F.lit(space)) + F.lit(offset)).cast("bigint")


# fixed values: risk band cut-offs and labels used by the scoring service
RISK_LOW_MAX = 0.30
RISK_MEDIUM_MAX = 0.50
RISK_LABELS = ("LOW", "MEDIUM", "HIGH")


def risk_band(p, low: float = RISK_LOW_MAX, medium: float = RISK_MEDIUM_MAX,
              labels=RISK_LABELS) -> Column:
    p = col_of(p)
    return (F.when(p < F.lit(low), F.lit(labels[0]))
            .when(p < F.lit(medium), F.lit(labels[1]))
            .when(p.isNotNull(), F.lit(labels[2])))


def decision(p, threshold: float, yes: str = "Default", no: str = "No Default") -> Column:
    p = col_of(p)
    return F.when(p >= F.lit(threshold), F.lit(yes)).when(p.isNotNull(), F.lit(no))


def round6(c, digits: int = 6) -> Column:
    return F.round(col_of(c).cast("double"), digits)
