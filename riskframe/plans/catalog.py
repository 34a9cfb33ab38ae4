"""All bound queries: importing this module registers every plan module."""

from __future__ import annotations

import importlib

from riskframe.plans.registry import REGISTRY

PLAN_MODULES = ["q_marts", "q_features", "q_checks", "q_metrics", "q_drift", "q_relational", "q_profiles", "q_fit", "q_io", "q_stream", "q_model", "q_state"]

ORACLE: dict[str, str] = {}
for _m in PLAN_MODULES:
    _mod = importlib.import_module(f"riskframe.plans.{_m}")
    ORACLE.update(getattr(_mod, "ORACLE", {}))


def queries():
    return {k: b.build for k, b in REGISTRY.items()}


def oracle_sql():
    return {k: ORACLE[k] for k in REGISTRY if ORACLE.get(k)}
