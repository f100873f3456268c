"""Loads every query module of this subpackage, and the pipeline."""

from __future__ import annotations

import importlib
import pkgutil

import tracewell.llm as llm
from tracewell.llm.registry import ORACLES, QUERIES

for _m in pkgutil.iter_modules(llm.__path__):
    if _m.name.startswith("q_"):
        importlib.import_module(f"tracewell.llm.{_m.name}")

__all__ = ["QUERIES", "ORACLES"]
