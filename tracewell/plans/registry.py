"""Registry of named queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, rounded: tuple[str, ...] = ()):
    """Register ``fn(spark, sf_dir)`` under an operator id, with an optional SQL counterpart.

    ``rounded`` columns come from sums of fractions or from exp and log, whose last digit depends
    on the order of the additions; both sides round them to nine digits.
    """
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark, sf_dir):
            df = fn(spark, sf_dir)
            return df.withColumns({c: F.round(c, 9) for c in rounded}) if rounded else df

        QUERIES[name] = run
        if sql is not None:
            cut = ", ".join(f"round({c}, 9) AS {c}" for c in rounded)
            ORACLES[name] = f"SELECT * REPLACE ({cut}) FROM ({sql})" if rounded else sql
        return fn
    return add
