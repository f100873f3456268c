"""Loads every query module into the registry."""

from __future__ import annotations

import importlib
import pkgutil

import tracewell.plans as plans
from tracewell.plans.registry import ORACLES, QUERIES

for _m in pkgutil.iter_modules(plans.__path__):
    if _m.name.startswith("q_"):
        importlib.import_module(f"tracewell.plans.{_m.name}")

__all__ = ["QUERIES", "ORACLES", "flagship"]


def flagship(spark, sf_dir):
    return QUERIES["actor_ranking"](spark, sf_dir)
