import random

import numpy as np
import pytest

from pyspark.sql import functions as F
from tracewell.operators import partition as P


def test_running_totals_by_key(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), i, rng.randrange(5)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, t int, v int").repartition(6)
    got = P.running_totals(df, [F.col("t")], F.floor(F.col("t") / 17), {"s": F.col("v")}, ["k"])
    run = {}
    want = {}
    for k, t, v in rows:
        run[k] = run.get(k, 0) + v
        want[t] = run[k]
    for r in got.collect():
        assert r["s"] == want[r["t"]] and r["s_all"] == run[r["k"]]


@pytest.mark.parametrize("p", [0.0, 0.01, 0.5, 0.95, 0.999, 1.0])
def test_quantiles_interpolate(spark, p):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.random(301), np.full(100, 0.25), [0.0, 1.0], rng.random(50) * 1e-6])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = P.exact_quantiles(df, "v", {"q": p}, P.unit_bucket(F.col("v"))).first()["q"]
    assert got == pytest.approx(np.quantile(values, p), rel=1e-12)


def test_unit_bucket_rises_with_the_score(spark):
    values = sorted([0.0, 1e-300, 1e-9, 1e-6, 0.1, 0.3, 0.5, 0.9, 1 - 1e-9, 1.0, *np.random.default_rng(
        1).random(1000).tolist()])
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(
        "v", P.unit_bucket(F.col("v")).alias("b")).orderBy("v").collect()
    bs = [r["b"] for r in rows]
    assert bs == sorted(bs) and bs[0] == 0 and bs[-1] == 65536


def test_draw_number_rises_with_the_key(spark):
    rows = spark.range(5000).withColumn("h", P.draw_key(["id"])).withColumn(
        "b", P.draw_number(F.col("h"), 3)).orderBy("h").collect()
    b = [r["b"] for r in rows]
    assert b == sorted(b) and 0 <= b[0] and b[-1] < 4096 and len(set(b)) > 2500
