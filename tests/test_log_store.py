"""The log store: which rows and files a range reads, and what a stream reads when."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from tracewell.sources import logstore as L
from tracewell.streaming import jobs as S

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "n bigint, time_generated timestamp, category string, log_s string"


def _at(minutes):
    return None if minutes is None else T0 + dt.timedelta(minutes=minutes)


def _add(spark, path, rows):
    L.write_log_store(spark.createDataFrame([(n, _at(m), c, f"x{n}") for n, m, c in rows], SCHEMA)
                      .withColumn("extra", F.lit(1)), path)


@pytest.fixture
def store(spark, tmp_path):
    path = str(tmp_path / "store")
    _add(spark, path, [(i, i * 7, ("kube-audit", "other", "kube-audit-admin", None)[i % 4]) for i in range(200)]
         + [(1000, None, "kube-audit")])
    return path


def _ns(df):
    return sorted(r["n"] for r in df.collect())


def test_bounds_reach_the_source(spark, store):
    def read(start=None, end=None, categories=()):
        return L.read_log_store(spark, store, SCHEMA, _at(start), _at(end), categories)

    assert _ns(read()) == [*range(200), 1000]
    assert _ns(read(100, 700, ("kube-audit", "kube-audit-admin"))) == [
        i for i in range(200) if 100 <= i * 7 <= 700 and i % 4 in (0, 2)]
    assert _ns(read(14, 28)) == [2, 3, 4] and _ns(read(14, 14)) == [2] and _ns(read(None, 0)) == [0]
    assert _ns(read(1300)) == [i for i in range(200) if i * 7 >= 1300]
    assert _ns(read(categories=("nothing",))) == [] and _ns(read(28, 14)) == []
    assert _ns(read().where(F.col("category").isNull() & (F.col("n") < 9))) == [3, 7]
    assert _ns(read().where(F.col("time_generated").isNull())) == [1000]
    # Two reads in one plan keep their own bounds; so do two filters over one read.
    assert _ns(read(0, 7).union(read(700, 707))) == [0, 1, 100, 101]
    both = read(0, 70)
    assert _ns(both.where("n < 2").union(both.where("n > 8")).union(both)) == sorted([0, 1, 9, 10, *range(11)])
    assert read().columns == ["n", "time_generated", "category", "log_s"]


def test_files_outside_the_range_are_not_opened(spark, store):
    late = glob.glob(f"{store}/hour={int(T0.timestamp()) // 3600 + 20}/*.parquet")
    assert late
    for f in late:
        with open(f, "wb") as out:
            out.write(b"broken")
    early = L.read_padded_range(spark, store, _at(60), _at(120), SCHEMA)
    assert _ns(early) == [i for i in range(200) if 58 <= i * 7 <= 126]
    with pytest.raises(Exception, match="broken|footer|Parquet"):
        L.read_log_store(spark, store, SCHEMA).collect()


def test_no_rows(spark, tmp_path):
    assert L.read_log_store(spark, str(tmp_path / "none"), SCHEMA).count() == 0


def test_stream_reads_every_file_once(spark, tmp_path):
    path, out, state = (str(tmp_path / n) for n in ("s", "out", "cp"))

    def drain():
        rows = L.stream_log_store(spark, path, SCHEMA, ("kube-audit", "late"), settle_seconds=0)
        return _ns(S.run_to_table(rows, out, state))

    _add(spark, path, [(i, i, "kube-audit") for i in range(100)] + [(500, 3, "other"), (501, None, "kube-audit")])
    assert drain() == list(range(100))
    assert drain() == list(range(100))
    # The newest hour began at minute 60: ten minutes before it are still read, earlier rows are not.
    _add(spark, path, [(200, 55, "late"), (201, 50, "late"), (202, 49, "late"), (203, 130, "kube-audit"), (204, 1, "late")])
    want = sorted([*range(100), 200, 201, 203])
    assert drain() == want
    # Now it began at minute 120, and a source that starts anew goes on where the last one stopped.
    _add(spark, path, [(300, 109, "late"), (301, 111, "late"), (302, 111, "other")])
    assert drain() == sorted([*want, 301])
    files = {os.path.basename(f) for f in glob.glob(f"{state}/offsets/*")}
    assert {"0", "1", "2"} <= files
