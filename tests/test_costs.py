"""What state, scoring, header look-up and address tests cost: calls, passes, plans and parts."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tracewell.functions import scalars as C
from tracewell.models import learners as L
from tracewell.sources import readers as R
from tracewell.streaming import rules as RU
from tracewell.streaming import state as ST


class Handle:
    """State variables in memory that count their calls."""

    def __init__(self):
        self.calls, self.value, self.map = 0, None, {}

    def getValueState(self, name, schema):
        handle = self

        class Value:
            def exists(self):
                handle.calls += 1
                return handle.value is not None

            def get(self):
                handle.calls += 1
                return handle.value

            def update(self, value):
                handle.calls += 1
                handle.value = value

        return Value()

    def getMapState(self, name, key, value):
        handle = self

        class Map:
            def containsKey(self, k):
                handle.calls += 1
                return k in handle.map

            def updateValue(self, k, v):
                handle.calls += 1
                handle.map[k] = v

            def clear(self):
                handle.calls += 1
                handle.map.clear()

        return Map()

    def registerTimer(self, ms):
        self.calls += 1

    def deleteTimer(self, ms):
        self.calls += 1


def test_notifications_ask_the_state_once_per_instance():
    handle, made = Handle(), RU.Notify(5, 10, 10**9)
    made.init(handle)
    rows = [Row(ts=None, us=i, alertname="a", instance=f"n{i % 4}") for i in range(5000)]
    assert sum(r["firings"] for r in made.handleInputRows(("a",), iter(rows), None)) > 0
    assert handle.calls < 20 and set(handle.map) == {(f"n{i}",) for i in range(4)}


def test_history_reads_and_writes_its_state_once_per_key_and_batch():
    rng, handle = random.Random(3), Handle()
    made = ST.LastEvents(20, 16, 4, 5, False)
    made.init(handle)
    every, got = [], []
    for batch in range(3):
        rows = [([rng.random() < 0.5 for _ in range(16)], rng.randrange(16), [rng.choice(["a", "b", "c", None]) for _ in range(5)])
                for _ in range(40)]
        before = handle.calls
        pack = [{f"flag{w}": sum(f[i] << s for i, (at, s) in enumerate(made.flags.places) if at == w)
                 for w in range(made.flags.words)} for f, _, _ in rows]
        got += made.handleInputRows(("k",), iter([
            Row(us=len(every) + j, id=j, note=None, steps=s, row=len(every) + j, **words, **{f"value{i}": x for i, x in enumerate(v)})
            for j, ((f, s, v), words) in enumerate(zip(rows, pack))]), None)
        assert handle.calls - before <= 3
        every += rows
    for at, r in enumerate(got):
        last = every[max(0, at - 19):at + 1]
        mask = (1 << made.flags.bits) - 1
        assert [r[f"sum{w}"] >> s & mask for w, s in made.flags.places] == [sum(f[i] for f, _, _ in last) for i in range(16)]
        assert [r[f"kind{w}"] >> s & mask for w, s in made.kinds.places] == [
            len({v[i] for _, _, v in last} - {None}) for i in range(5)]
        assert list(r["totals"]) == [sum(s >> i & 1 for _, s, _ in every[:at + 1]) for i in range(4)]


IPS = ["10.244.0.1", "10.244.255.255", "10.245.0.0", "010.244.1.1", "10.244.1", "10.244.1.1.1", "10.244.256.1", "10.244.1.1\n",
       "10.244.1.1 ", "x10.244.1.1", "10.244.1.0001", "", None, "255.255.255.255", "0.0.0.0", "10.96.0.0", "10.111.255.255",
       "10.112.0.0", "300.1.1.1"]
IN_POD = {"10.244.0.1", "10.244.255.255", "010.244.1.1", "10.244.1.1\n"}


def test_addresses_are_read_by_codegen_expressions(spark):
    df = spark.createDataFrame([(x,) for x in IPS], "ip string").select(
        "ip", C.in_network(F.col("ip"), "10.244.0.0/16").alias("pod"), C.in_network(F.col("ip"), "10.96.0.0/12").alias("service"),
        C.ipv4_to_long(F.col("ip")).alias("n"))
    rows = {r["ip"]: r for r in df.collect()}
    assert {x for x in IPS if rows[x]["pod"]} == IN_POD
    assert {x for x in IPS if rows[x]["service"]} == {"10.96.0.0", "10.111.255.255"}
    assert rows["255.255.255.255"]["n"] == (1 << 32) - 1 and rows["300.1.1.1"]["n"] is None and rows[""]["n"] is None
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "regexp_extract_all" not in plan


def test_headers_are_found_without_sorting_lines(spark, tmp_path):
    for name, text in (("a.csv", "x,y\n1,2\n3,4\n"), ("b.csv", "y,z\n" + "9,9\n" * 5000), ("c.csv", "x,y\n")):
        (tmp_path / name).write_text(text)
    found = R.header_lines(spark, str(tmp_path))
    assert {r["path"].rsplit("/", 1)[1]: r["header"] for r in found.collect()} == {"a.csv": "x,y", "b.csv": "y,z", "c.csv": "x,y"}
    assert "SortAggregate" not in found._jdf.queryExecution().toString()


def test_a_model_scores_each_row_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def score(x):
        seen.add(1)
        return x / 100.0

    df = spark.range(100).select((F.col("id") % 2).cast("int").alias("label"), F.udf(score, "double")("id").alias("prob"))
    assert L.metrics_row(df).first()["tp"] == 25
    assert seen.value == 100


def test_selection_makes_its_training_table_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return float(x % 7)

    df = spark.range(60).select(F.udf(count, "double")("id").alias("a"), (F.col("id") % 2).cast("int").alias("label"))
    plain = spark.range(60).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 2).cast("int").alias("label"))
    rows = L.select_model(df, plain, plain, ["a"], [("one", L.gbt(1, 2)), ("two", L.gbt(1, 1))])
    assert len(rows) == 2 and seen.value == 60


@pytest.mark.parametrize("most,parts", [(100, 10), (10_000, 4)])
def test_parts_of_a_fit_are_bounded(spark, most, parts):
    rows = L.small_parts(spark.range(0, 1000, 1, 4), most)
    assert rows.rdd.getNumPartitions() == parts
    assert sorted(r["id"] for r in rows.collect()) == list(range(1000))
