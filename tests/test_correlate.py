import random

import pytest
from helpers import incidents_by_hand, strongest_chain

from pyspark.sql import functions as F
from tracewell.functions import constants as K
from tracewell.operators import correlate as C

SCHEMA = "seq bigint, us bigint, actor string, component string, calibrated double, hint string"
GAP = 60_000_000


def _alerts(n, seed):
    rng = random.Random(seed)
    tokens = sorted({t for _, seq, _ in K.CHAINS for t in seq}) + ["", "other"]
    rows, us = [], 0
    for i in range(n):
        us += rng.choice([0, 1_000_000, 30_000_000, GAP, GAP + 1])
        rows.append((i, us, rng.choice("xyz"), rng.choice(["c0", "c1"]), rng.random(),
                     rng.choice(tokens)))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_incidents_and_chains_match_a_plain_model(spark, seed):
    rows = _alerts(400, seed)
    df = C.assign_incidents(spark.createDataFrame(rows, SCHEMA).repartition(5))
    inc = {(r["actor"], r["start_us"]): r for r in C.assemble(df).collect()}
    match = {(r["actor"], r["start_us"]): r["chain_matched"] for r in C.match_chains(df).collect()}
    parts = C.incident_sequence(df, part_rows=4).orderBy("actor", "start_us", "part").collect()
    seqs = {}
    for r in parts:
        assert len(r["hints"]) <= 4
        seqs.setdefault((r["actor"], r["start_us"]), []).extend(r["hints"])
    want = incidents_by_hand([(a[0], a[1], a[2], a[5]) for a in rows], GAP)
    assert len(inc) == len(want)
    for actor, start, hints in want:
        key = (actor, start)
        assert inc[key]["n_hints"] == len(hints)
        assert seqs.get(key, []) == hints
        assert match.get(key) == strongest_chain(hints, K.CHAINS), key


def test_gap_is_inclusive(spark):
    rows = [(0, 0, "a", "c", 0.5, ""), (1, GAP, "a", "c", 0.6, ""), (2, 2 * GAP + 1, "a", "c", 0.7, "")]
    out = C.assemble(C.assign_incidents(spark.createDataFrame(rows, SCHEMA))).orderBy("start_us").collect()
    assert [(r["start_us"], r["end_us"], r["n_alerts"]) for r in out] == [
        (0, GAP, 2), (2 * GAP + 1, 2 * GAP + 1, 1)]


def test_equal_boosts_keep_catalogue_order(spark):
    hints = ["token_theft", "credential_theft", "privilege_escalation"]
    rows = [(i, i, "a", "c", 0.5, h) for i, h in enumerate(hints)]
    got = C.match_chains(C.assign_incidents(spark.createDataFrame(rows, SCHEMA))).first()
    assert got["chain_matched"] == "credential_to_escalation" and got["boost"] == 1.8


def test_boost_is_capped_and_low_is_the_floor(spark):
    rows = [("a", 0, 0.9, "x", 1.8), ("b", 0, 0.2, None, None)]
    inc = spark.createDataFrame([(r[0], r[1], r[2]) for r in rows],
                                "actor string, start_us bigint, base_score double")
    m = spark.createDataFrame([("a", 0, "x", 1.8)],
                              "actor string, start_us bigint, chain_matched string, boost double")
    got = {r["actor"]: r for r in C.severity(C.boost(inc, m)).collect()}
    assert got["a"]["boosted_score"] == 1.0 and got["a"]["severity"] == "CRITICAL"
    assert got["b"]["boosted_score"] == 0.2 and got["b"]["severity"] == "LOW"


def test_threshold_defaults_to_half(spark):
    a = spark.createDataFrame([(1, "k", 0.3), (2, "k", 0.1), (3, "u", 0.5), (4, "u", 0.49)],
                              "seq int, component string, raw_score double")
    t = spark.createDataFrame([("k", 0.2)], "component string, threshold double")
    assert {r["seq"] for r in C.apply_thresholds(a, t).collect()} == {1, 3}


def test_syscall_alerts(spark):
    rows = [
        (1, "2024-01-01T00:00:00Z", "Terminal shell in container", "Critical", "", {"k8s.pod.name": "p"}),
        (2, "2024-01-01T00:00:00Z", "Sensitive mount by ssh", "Odd", "", {"k8s_pod_name": "q"}),
        (3, "2024-01-01T00:00:00Z", "Other", "Debug", "service discovery", {}),
        (4, None, "Other", "Debug", "", {})]
    df = spark.createDataFrame(rows, "seq int, time string, rule string, priority string, "
                                     "output string, output_fields map<string,string>")
    pods = spark.createDataFrame([("p", "alice")], "pod string, actor string")
    got = {r["seq"]: (r["actor"], r["raw_score"], r["hint"])
           for r in C.alerts_from_syscalls(df, pods).collect()}
    assert got == {1: ("alice", 0.95, "container_exec"), 2: ("pod:q", 0.70, "credential_theft"),
                   3: ("unknown", 0.30, "discovery")}


def test_subsequence_helper(spark):
    from tracewell.functions.scalars import register_sql_functions, subsequence_match
    df = spark.createDataFrame([(["a", "x", "b"],), (["b", "a"],), ([],)], "s array<string>")
    assert [r[0] for r in df.select(subsequence_match(F.col("s"), ["a", "b"])).collect()] == [
        True, False, False]
    register_sql_functions(spark)
    assert spark.sql("SELECT subsequence_match(array('a','c','b'), array('a','b')), "
                     "round(wilson_lb(9, 9), 4)").first()[:] == (True, 0.7008)
