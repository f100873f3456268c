"""Live rules against the batch forms and notifications against a plain model, over several micro-batches."""

import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import monitor as M
from tracewell.streaming import jobs as S
from tracewell.streaming import rules as R

MINUTE = 60_000_000


def _stream(spark, tmp_path, rows, schema, batches):
    """The rows as files, one per micro-batch, in their order; ``ts`` is made from ``us``."""
    import os
    folder = tmp_path / "in"
    step = -(-len(rows) // batches)
    for i in range(batches):
        spark.createDataFrame(rows[i * step:(i + 1) * step], schema).coalesce(1).write.parquet(f"{folder}/f{i}")
        for name in os.listdir(f"{folder}/f{i}"):
            os.utime(f"{folder}/f{i}/{name}", (1_000_000_000 + i * 10,) * 2)
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
            .withColumn("ts", F.timestamp_micros("us")))


def _run(stream, tmp_path, name):
    return S.run_to_table(stream, str(tmp_path / name), str(tmp_path / f"{name}-cp"))


@pytest.mark.parametrize("batches", [1, 4])
def test_increase_and_offset_equal_batch(spark, tmp_path, batches):
    rng, rows, values = random.Random(6), [], {}
    for i in range(300):
        us = i * 7_000_000 + rng.randrange(3_000_000)
        label = rng.choice(["error", "ok", "purchase"])
        values[label] = 0 if rng.random() < 0.05 else values.get(label, 0) + rng.randrange(5)  # restarts
        if not 90 < i < 120:  # windows without a sample
            rows.append((us, i, "total", label, values[label]))
    end = rows[-1][0] + 60 * MINUTE
    rows.append((end, 999, "total", "late", 1))  # lets the watermark pass the rest
    schema = "us bigint, seq bigint, metric string, label string, value bigint"
    stream = _stream(spark, tmp_path, rows, schema, batches)
    batch = spark.createDataFrame(rows, schema)
    closed = F.col("win_us") < end - 15 * MINUTE - MINUTE
    got = _run(R.live_increase(stream, lateness="15 minutes"), tmp_path, "inc").where(closed)
    want = M.increase(batch).where(closed)
    cols = ["metric", "label", "win_us", "increase"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    got = _run(R.live_offset(stream, lateness="15 minutes"), tmp_path, "off").where(closed & (F.col("change") > 0))
    want = M.offset_rule(batch).where(closed)
    cols = ["win_us", "now", "change"]
    assert want.count() > 5
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def plain_notifications(rows, wait, interval, repeat, until):
    out, state = [], {}
    for us, name, instance in sorted(rows):
        g = state.setdefault(name, {"due": None, "last": None, "fired": None, "pending": 0, "known": set()})
        if g["due"] is not None and g["due"] <= us:
            out.append((name, g["due"], g["pending"], g["last"] is None))
            g |= {"last": g["due"], "due": None, "pending": 0}
        if g["due"] is None and g["last"] is not None and us - g["fired"] > repeat:
            g |= {"last": None, "known": set()}
        fresh = instance not in g["known"]
        g["known"].add(instance)
        g["pending"] += 1
        g["fired"] = us
        then = us + wait if g["last"] is None else max(us, g["last"] + (interval if fresh else repeat))
        if g["due"] is None or g["last"] is not None and then < g["due"]:
            g["due"] = then
    out += [(n, g["due"], g["pending"], g["last"] is None) for n, g in state.items()
            if g["due"] is not None and g["due"] <= until]
    return sorted(out)


@pytest.mark.parametrize("batches", [1, 5])
def test_notifications_over_triggers_equal_a_plain_model(spark, tmp_path, batches):
    rng, rows, us = random.Random(9), [], 0
    for i in range(260):
        us += rng.choice([500_000, 2_000_000, 4_000_000, 11_000_000, 90_000_000]) + i
        if rng.random() < 0.02:
            us += 40 * MINUTE
        rows.append((us, rng.choice(["cpu", "disk"]), f"n{rng.randrange(6)}"))
    rows.append((us + 60 * MINUTE, "end", "x"))
    stream = _stream(spark, tmp_path, rows, "us bigint, alertname string, instance string", batches)
    got = _run(R.notifications(stream, repeat_us=5 * MINUTE, lateness="1 second"), tmp_path, "notes")
    watermark = (rows[-1][0] // 1000 - 1000) * 1000
    want = plain_notifications(rows, 5_000_000, 10_000_000, 5 * MINUTE, watermark)
    assert len(want) > 20 and {w[3] for w in want} == {True, False}
    assert sorted((r["alertname"], r["notify_us"], r["firings"], r["first"]) for r in got.collect()) == want
