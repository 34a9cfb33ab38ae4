"""SQL spellings (DuckDB) of the feature expressions, for oracle statements."""

from __future__ import annotations

from riskframe.plans.sqlgen import rnd_sql

EPS = "1e-5"


def div(a: str, b: str, plus: str | None = EPS) -> str:
    den = f"(({b}) + {plus})" if plus else f"({b})"
    return f"(CAST({a} AS DOUBLE) / NULLIF(CAST({den} AS DOUBLE), 0))"


def clip_lower(x: str, lo: str = "0e0") -> str:
    return f"(CASE WHEN ({x}) < {lo} THEN {lo} ELSE ({x}) END)"


def clip(x: str, lo: str, hi: str) -> str:
    inner = clip_lower(x, lo)
    return f"(CASE WHEN {inner} > {hi} THEN {hi} ELSE {inner} END)"


def flag(cond: str) -> str:
    return f"CAST(COALESCE(({cond}), false) AS BIGINT)"


def log1p(x: str) -> str:
    return f"(CASE WHEN ({x}) > -1e0 THEN ln(1e0 + ({x})) END)"


def sqrt(x: str) -> str:
    return f"(CASE WHEN ({x}) >= 0e0 THEN sqrt({x}) END)"


def sqrt0(x: str) -> str:
    return f"sqrt({clip_lower(x)})"


def lst(cols) -> str:
    return "list_filter([" + ", ".join(f"CAST({c} AS DOUBLE)" for c in cols) + "], lambda x: x IS NOT NULL)"


def row_stat(cols, stat: str) -> str:
    fn = {"mean": "list_avg", "std": "list_stddev_samp", "max": "list_max", "min": "list_min",
          "median": "list_median"}
    if stat == "range":
        return f"(list_max({lst(cols)}) - list_min({lst(cols)}))"
    return f"{fn[stat]}({lst(cols)})"


def row_sum(cols) -> str:
    return "(" + " + ".join(f"COALESCE(CAST({c} AS DOUBLE), 0e0)" for c in cols) + ")"


def bins(x: str, edges, labels) -> str:
    parts = []
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        hi_s = "'Infinity'::DOUBLE" if hi == float("inf") else repr(float(hi))
        parts.append(f"WHEN ({x}) > {float(lo)!r} AND ({x}) <= {hi_s} THEN {float(lab)!r}")
    return "(CASE " + " ".join(parts) + " END)"


def select(pairs, source: str, keys=("SK_ID_CURR",), dbl_round=True, where: str = "") -> str:
    """SELECT keys + named expressions; doubles (kind 'd') are rounded."""
    sel = list(keys)
    for name, expr, kind in pairs:
        sel.append(f"{rnd_sql(expr) if (kind == 'd' and dbl_round) else expr} AS {name}")
    return f"SELECT {', '.join(sel)} FROM {source}" + (f" WHERE {where}" if where else "")
