"""Registered queries (one per inventory key) and their SQL oracles."""

from __future__ import annotations

import importlib

from tsq.plans.registry import ORACLES, QUERIES

_MODULES = ["features", "windows", "metrics", "functions", "clean", "joins", "evals", "scans", "misc", "spectral", "similarity", "augment", "streams", "augment_udf", "udf"]


def load_all() -> None:
    for m in _MODULES:
        importlib.import_module(f"tsq.plans.{m}")


def queries():
    load_all()
    return dict(QUERIES)


def oracle_sql():
    load_all()
    return dict(ORACLES)
