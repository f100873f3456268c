"""Running sums over sampled ranges against a plain loop."""

from pyspark.sql import functions as F

from tracewell.operators.partition import range_totals


def test_equal_prefixes_and_ties(spark):
    rows = [(f"system:serviceaccount:{i * 7 % 50:03d}", i % 5, i) for i in range(400)]
    df = spark.createDataFrame(rows, "name string, n bigint, id bigint")
    out = range_totals(df, [F.col("name"), F.col("id")],
                       {"cum": F.col("n"), "rank": F.lit(1)}).collect()
    cum, want = 0, {}
    for k, (name, n, i) in enumerate(sorted(rows, key=lambda r: (r[0], r[2])), 1):
        cum += n
        want[i] = (cum, k)
    assert {r["id"]: (r["cum"], r["rank"]) for r in out} == want


def test_no_rows(spark):
    df = spark.createDataFrame([], "name string, n bigint")
    assert range_totals(df, [F.col("name")], {"cum": F.col("n")}).count() == 0
