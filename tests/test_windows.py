import pytest
from helpers import EVENT_SCHEMA, features_by_hand, random_events, times_by_hand

from pyspark.sql import functions as F
from tracewell.functions import constants as K
from tracewell.operators import windows as W

# Unsplit, and cut into many small chunks with buckets of ten seconds.
SPLITS = [{}, {"chunk_rows": 30, "bucket_us": 10_000_000}, {"chunk_rows": 3, "bucket_us": 1_000_000}]


@pytest.mark.parametrize("split", SPLITS)
@pytest.mark.parametrize("seed", [1, 2])
def test_features_match_a_plain_model(spark, split, seed):
    rows = random_events(600, seed)
    df = spark.createDataFrame(rows, EVENT_SCHEMA).repartition(7)
    got = {r["audit_id"]: r for r in W.window_features(df, **split).collect()}
    want = features_by_hand(rows)
    assert len(got) == len(want) == 600
    for key, f in want.items():
        for name in K.ALL_FEATURES:
            assert got[key][name] == f[name], (key, name)


@pytest.mark.parametrize("split", SPLITS)
def test_time_features_match_a_plain_model(spark, split):
    rows = random_events(500, 5, step_us=5_000_000)
    df = spark.createDataFrame(rows, EVENT_SCHEMA).repartition(5)
    cols = ["events_5s", "events_60s", "distinct_resources_60s", "distinct_verbs_60s",
            "errors_60s", "readonly_ratio_60s", "secs_since_prev"]
    got = {r["audit_id"]: tuple(r[c] for c in cols) for r in W.time_features(df, **split).collect()}
    want = times_by_hand(rows)
    assert got.keys() == want.keys()
    for key in want:
        assert got[key] == pytest.approx(want[key]), key


def test_bounds_are_inclusive(spark):
    base = random_events(4, 1)[0]
    times = [0, 5_000_000, 60_000_000, 60_000_000, 60_000_001]
    rows = [(i, t, 0, "a", "get", f"r{i}", *base[6:]) for i, t in enumerate(times)]
    got = {r["audit_id"]: r for r in W.time_features(
        spark.createDataFrame(rows, EVENT_SCHEMA)).collect()}
    assert got[1]["events_5s"] == 2
    assert got[2]["events_60s"] == 3 and got[2]["distinct_resources_60s"] == 3
    assert got[3]["events_60s"] == 4
    assert got[4]["events_60s"] == 4


def test_ratio_rounds_half_to_even(spark):
    base = random_events(1, 1)[0]
    rows = [(i, i * 1_000_000, 0, "a", "get", "pods", "", "", 200,
             "forbid" if i == 0 else "allow", "", 0, "", 0, base[-1]) for i in range(16)]
    got = W.window_features(spark.createDataFrame(rows, EVENT_SCHEMA)).where("audit_id = 15").first()
    assert got["forbid_ratio"] == 0.062


@pytest.mark.parametrize("split", SPLITS)
def test_tokens_and_bursts(spark, split):
    rows = random_events(200, 9)
    df = spark.createDataFrame(rows, EVENT_SCHEMA)
    tok = {r["audit_id"]: r["tokens"] for r in W.token_windows(df, **split).collect()}
    burst = {r["audit_id"]: r["burst_max"] for r in W.longest_burst(df, **split).collect()}
    hist = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        h = hist.setdefault((r[2], r[3]), [])
        h.append((f"{r[4]}:{r[5]}:{r[6]}", r[4] == "create" and r[5].startswith("selfsubject")))
        win = h[-20:]
        assert tok[r[0]] == ["<PAD>"] * (20 - len(win)) + [t for t, _ in win]
        best = run = 0
        for _, x in win:
            run = run + 1 if x else 0
            best = max(best, run)
        assert burst[r[0]] == best


def test_last_window_is_the_newest(spark):
    rows = random_events(300, 3)
    feats = W.window_features(spark.createDataFrame(rows, EVENT_SCHEMA))
    got = W.last_window(feats).select("session", "actor", "audit_id").collect()
    want = {}
    for r in rows:
        key = (r[2], r[3])
        want[key] = max(want.get(key, (-1, -1)), (r[1], r[0]))
    assert {(r[0], r[1]): r[2] for r in got} == {k: v[1] for k, v in want.items()}


def test_chunks_are_bounded(spark):
    from tracewell.operators.partition import split_hot_groups
    df = spark.createDataFrame(random_events(2000, 4, hot=0.9), EVENT_SCHEMA)
    cut = split_hot_groups(df, ["actor"], halo_rows=19, chunk_rows=100, bucket_us=5_000_000)
    sizes = cut.groupBy("actor", "_chunk").agg(
        F.count_if(~F.col("_halo")).alias("own"), F.count_if("_halo").alias("copied")).collect()
    assert sum(r["own"] for r in sizes) == 2000
    assert max(r["own"] for r in sizes) < 200 and max(r["copied"] for r in sizes) < 60
    assert len(sizes) > 10
