"""The queries of the operators against their SQL, on the small tables."""

import math

import duckdb
import pandas as pd
import pytest

from tracewell.llm.catalog import ORACLES, QUERIES

TABLES = ["documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _value(v):
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return ""
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def _rows(pdf):
    pdf = pdf[sorted(pdf.columns)].astype(object)
    return sorted(tuple(_value(v) for v in r) for r in pdf.itertuples(index=False))


def test_one_query_per_operator():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = QUERIES[name](spark, sf).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)
