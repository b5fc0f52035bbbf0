"""All registered queries."""

from __future__ import annotations

import importlib

from abundix.plans.registry import ORACLES, QUERIES

MODULES = ("shaping", "identification", "statistics", "enrichment", "multivariate")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"abundix.plans.{name}")


def queries():
    _load()
    return dict(QUERIES)


def oracle_sql():
    _load()
    return dict(ORACLES)


def flagship(spark, folder):
    return queries()["entry_slice"](spark, folder)
