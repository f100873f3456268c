import pytest
from helpers import EVENT_SCHEMA, random_events

from pyspark.sql import functions as F
from tracewell.functions import constants as K
from tracewell.operators import correlate as C
from tracewell.operators import windows as W
from tracewell.streaming import jobs as S
from tracewell.operators.rules import window_signals
from tracewell.streaming.state import ActorHistory, episode_alerts, first_seen, live_alerts


def _feed(spark, tmp_path, rows, files):
    """Write the rows as time-ordered files, read one per micro-batch."""
    import os
    import time
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    step = -(-len(rows) // files)
    folder = str(tmp_path / "in")
    for i in range(files):
        part = spark.createDataFrame(rows[i * step:(i + 1) * step], EVENT_SCHEMA)
        part.coalesce(1).write.mode("append").parquet(folder)
        for name in os.listdir(folder):  # the source orders files by time
            if name.endswith(".parquet") and not name.startswith("seen"):
                os.utime(f"{folder}/{name}", (1_000_000 + i * 10,) * 2) if os.path.getmtime(
                    f"{folder}/{name}") > 2_000_000_000 / 2 else None
        time.sleep(0.01)
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def _rising(rows):
    """Distinct times, so that a tie never straddles two batches."""
    return [(r[0], r[1] + i, *r[2:]) for i, r in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))]


COLS = ["audit_id", *K.ALL_FEATURES]


def _same(got, want, cols=COLS):
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, got.select(cols).collect()), key=key) == sorted(map(tuple, want.select(cols).collect()), key=key)


@pytest.mark.parametrize("files", [1, 4])
def test_history_over_batches_equals_batch(spark, tmp_path, files):
    rows = _rising(random_events(300, 11))
    stream = _feed(spark, tmp_path, rows, files)
    got = S.run_to_table(ActorHistory().features(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    _same(got, W.window_features(spark.createDataFrame(rows, EVENT_SCHEMA)))
    tokens = S.run_to_table(ActorHistory().token_windows(stream), str(tmp_path / "tok"), str(tmp_path / "tcp"))
    _same(tokens, W.token_windows(spark.createDataFrame(rows, EVENT_SCHEMA)), ["audit_id", "tokens"])


def test_restart_in_the_middle_goes_on_from_the_checkpoint(spark, tmp_path):
    rows = _rising(random_events(200, 12))
    folder = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(EVENT_SCHEMA).parquet(folder)
    for part in (rows[:90], rows[90:150], rows[150:]):
        spark.createDataFrame(part, EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        got = S.run_to_table(ActorHistory().features(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    _same(got, W.window_features(spark.createDataFrame(rows, EVENT_SCHEMA)))


def test_history_starts_with_what_a_batch_table_left(spark, tmp_path):
    rows = _rising(random_events(240, 14))
    early = spark.createDataFrame(rows[:160], EVENT_SCHEMA)
    stream = _feed(spark, tmp_path, rows[160:], 2)
    got = S.run_to_table(ActorHistory(before=early).features(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    want = W.window_features(spark.createDataFrame(rows, EVENT_SCHEMA)).join(
        early.select("audit_id"), "audit_id", "left_anti")
    _same(got, want)


def test_idle_actors_are_forgotten(spark, tmp_path):
    """An actor that comes back after the idle time starts anew, one that doesn't pause goes on."""
    base = random_events(1, 1)[0]
    second = 1_000_000
    times = {"pauses": [0, 1, 200, 201], "stays": [0, 50, 100, 150, 200, 250]}
    rows = sorted((t * second, a) for a, ts in times.items() for t in ts)
    rows = [(i, 10**15 + us, 0, a, *base[4:]) for i, (us, a) in enumerate(rows)]
    stream = _feed(spark, tmp_path, rows, 5).withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", "1 second")
    got = S.run_to_table(ActorHistory(idle_us=100 * second).features(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    seen = {(r["actor"], (r["us"] - 10**15) // second): r["n_events"] for r in got.collect()}
    assert [seen["stays", t] for t in times["stays"]] == [1, 2, 3, 4, 5, 6]
    assert [seen["pauses", t] for t in times["pauses"]] == [1, 2, 1, 2]


@pytest.mark.parametrize("again,want", [(False, [2]), (True, [2, 3])])
def test_episode_alert_on_rising_edge(spark, tmp_path, again, want):
    folder = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    schema = "session bigint, actor string, prob double"
    stream = spark.readStream.schema(schema).parquet(folder)
    for probs in [[0.9, 0.1], [0.7], [0.8]]:
        spark.createDataFrame([(1, "a", p) for p in probs], schema).coalesce(1).write.mode("append").parquet(folder)
        out = S.run_to_table(episode_alerts(stream, re_alert=again), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r["n_windows_fired"] for r in out.collect()) == want


@pytest.mark.parametrize("files", [1, 5])
def test_live_alerts_keep_reasons_and_last_event_over_batches(spark, tmp_path, files):
    rows = _rising(random_events(250, 15))
    score = lambda df: df.withColumn("prob", (F.col("us") % 10) / 10.0)
    stream = _feed(spark, tmp_path, rows, files)
    got = S.run_to_table(live_alerts(stream, score, k=3, re_alert=True), str(tmp_path / "out"), str(tmp_path / "cp"))
    batch = score(W.window_features(spark.createDataFrame(rows, EVENT_SCHEMA)))
    want = batch.groupBy("session", "actor").agg(
        F.count_if(F.col("prob") >= 0.5).alias("n"), F.max("prob").alias("p"),
        F.max_by(F.struct("verb", "resource"), F.struct("us", "audit_id")).alias("last"),
        *[F.bool_or(c).alias(n) for n, c in window_signals().items()]).where("n >= 3").collect()
    # The last record of an episode sums up all of its batches.
    last = {}
    for r in sorted(got.collect(), key=lambda r: r["n_windows_fired"]):
        last[r["session"], r["actor"]] = (r["n_windows_fired"], r["max_prob"], r["last_verb"], r["last_resource"], r["reasons"])
    full = {(r["session"], r["actor"]): (r["n"], r["p"], r["last"]["verb"], r["last"]["resource"],
                                         [n for n in window_signals() if r[n]]) for r in want}
    assert set(last) == set(full)
    assert all(last[k][4] == full[k][4] for k in full if last[k][0] == full[k][0])
    if files == 1:
        assert last == full
    actors = S.run_to_table(first_seen(stream, "actor"), str(tmp_path / "actors"), str(tmp_path / "acp"))
    assert sorted(r[0] or "" for r in actors.collect()) == sorted({r[3] or "" for r in rows})


def test_dedup_keeps_rows_without_id(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("x", 1), ("x", 2), ("", 3), ("", 4), (None, 5), ("y", 6)]
    spark.createDataFrame(rows, "audit_key string, n int").withColumn(
        "ts", F.lit("2024-01-01").cast("timestamp")).write.parquet(src)
    stream = spark.readStream.schema("audit_key string, n int, ts timestamp").parquet(src)
    out = S.run_to_table(S.dedup(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = [r["n"] for r in out.collect()]
    assert len(got) == 5 and {3, 4, 5, 6} <= set(got)


def test_live_incidents_equal_batch_incidents(spark, tmp_path):
    minute = 60_000_000
    times = [0, 30, 60, 121, 200, 3600]
    rows = [(i, t * 1_000_000, "a" if i % 2 else "b", 0.1 * i, "h" if i % 3 else "") for i, t in enumerate(times)]
    schema = "seq bigint, us bigint, actor string, raw_score double, hint string"
    df = spark.createDataFrame(rows, schema)
    src = str(tmp_path / "in")
    df.write.parquet(src)
    stream = spark.readStream.schema(schema).parquet(src).withColumn("ts", F.timestamp_micros("us"))
    live = S.run_to_table(S.incident_sessions(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    batch = C.assemble(C.assign_incidents(
        df.withColumn("component", F.lit("c")).withColumn("calibrated", F.col("raw_score"))))
    closed = batch.where(F.col("end_us") + minute <= 3600_000_000 - 15 * minute)
    cols = ["actor", "start_us", "end_us", "n_alerts", "n_hints"]
    assert sorted(map(tuple, live.select(cols).collect())) == sorted(map(tuple, closed.select(cols).collect()))
