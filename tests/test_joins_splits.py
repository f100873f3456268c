import random

import pytest

from pyspark.sql import functions as F
from tracewell.operators import joins as J
from tracewell.operators import normalize as N
from tracewell.operators import splits as SP


@pytest.mark.parametrize("broadcast_cells", [J.BROADCAST_CELLS, 0])
@pytest.mark.parametrize("system_too", [True, False])
def test_first_interval_wins(spark, broadcast_cells, system_too):
    rng = random.Random(7)
    spans = [(i, s, s + rng.randrange(5000), f"v{i % 4}") for i, s in
             enumerate(rng.randrange(100_000) for _ in range(60))]
    spans += [(100 + i, 40_000 + i % 7, 40_900 + i % 5, "crowd") for i in range(300)]
    events = [(i, rng.randrange(110_000), rng.choice(["u", "system:x"])) for i in range(400)]
    events += [(1000 + i, s[1], "u") for i, s in enumerate(spans)]
    events += [(2000 + i, s[2], "u") for i, s in enumerate(spans)]
    # Blank, null and repeated ids, and a null time.
    events += [(None, us, "u") for us in range(0, 100_000, 997)] + [(7, us, "u") for us in range(0, 100_000, 1009)]
    events += [(5000, None, "u")]
    ev = spark.createDataFrame(events, "audit_id int, us bigint, actor string")
    sp = spark.createDataFrame(spans, "pos int, start_us bigint, end_us bigint, v string")
    applies = None if system_too else ~F.col("actor").startswith("system:")
    got = J.first_match_interval(
        ev, sp, {"hit": F.col("v")}, applies=applies, broadcast_cells=broadcast_cells).collect()

    def want(us, actor):
        if us is None or (not system_too and actor.startswith("system:")):
            return None
        return next((v for _, s, e, v in spans if s <= us <= e), None)

    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(((*e, want(e[1], e[2])) for e in events), key=key)


@pytest.mark.parametrize("broadcast_cells", [J.BROADCAST_CELLS, 0])
def test_a_hundred_thousand_intervals_in_one_hour(spark, broadcast_cells):
    """All of them overlap; the winner at a time is the lowest open place."""
    rng, hour = random.Random(21), 3_600_000_000
    half = hour // 2
    n = 100_000
    places = rng.sample(range(n), n)
    spans = [(p, 7 * hour + rng.randrange(half), 7 * hour + half + rng.randrange(half), f"v{p}") for p in places]
    events = [(i, 7 * hour + rng.randrange(hour)) for i in range(2_000)]
    ev = spark.createDataFrame(events, "id int, us bigint")
    sp = spark.createDataFrame(spans, "pos int, start_us bigint, end_us bigint, v string")
    got = {r["id"]: r["hit"] for r in J.first_match_interval(
        ev, sp, {"hit": F.col("v")}, broadcast_cells=broadcast_cells).collect()}
    starts, bounds = sorted(spans), {}
    for i, us in events:
        bounds[i] = next((v for _, s, e, v in starts if s <= us <= e), None)
    assert got == bounds


def test_interval_cells_are_disjoint_and_whole(spark):
    rng = random.Random(5)
    spans = [(i, a, a + rng.choice([0, 1, 15, 16, 17, 255, 256, 4_000])) for i, a in
             enumerate(rng.randrange(-5_000, 5_000) for _ in range(80))]
    spans += [(80, 5, 4), (81, -(1 << 63), (1 << 63) - 1), (82, None, 9)]
    sp = spark.createDataFrame(spans, "pos int, start_us bigint, end_us bigint")
    for pos, start, end in spans[:80:13]:
        cells = J.interval_index(sp.where(F.col("pos") == pos)).collect()
        times = sorted(t for r in cells for t in range(r["cell"] << 4 * r["level"], (r["cell"] + 1) << 4 * r["level"]))
        assert times == list(range(start, end + 1)) and len(cells) <= 90
    ev = spark.createDataFrame([(t,) for t in range(-6_000, 10_000, 7)], "us bigint")
    got = {r["us"]: r["p"] for r in J.first_match_interval(ev, sp, {"p": F.col("pos")}).collect()}
    for us, p in got.items():
        assert p == next((i for i, a, b in spans[:80] if a <= us <= b), 81)


@pytest.mark.parametrize("literal_rows", [1000, 0])
def test_token_codes_keep_every_row(spark, literal_rows):
    rows = [(1, ["a", "b", "zz"]), (1, ["b"]), (None, ["a"]), (2, []), (3, None), (1, ["b"]), (4, [None, "a"])]
    df = spark.createDataFrame(rows, "id int, tokens array<string>")
    vocab = spark.createDataFrame([("a", 2), ("b", 3)], "token string, id bigint")
    got = [tuple(r) for r in SP.encode_tokens(df, vocab, ["id"], literal_rows=literal_rows).collect()]
    codes = {"a": 2, "b": 3}
    assert sorted(map(str, got)) == sorted(str((i, t if t is None else [codes.get(x, 1) for x in t])) for i, t in rows)


@pytest.mark.parametrize("few", [0, 3, 40])
def test_a_class_with_few_rows_is_topped_up_from_the_other(spark, few):
    from hashlib import md5
    rows = [(i, 1 if i < few else 0) for i in range(400)]
    got = SP.sample_stratified(spark.createDataFrame(rows, "row_id int, label int"), 60).collect()
    order = sorted(rows, key=lambda r: (md5(f"123|{r[0]}".encode()).hexdigest(), r[0]))
    half = [r for c in (0, 1) for r in [x for x in order if x[1] == c][:30]]
    want = [*half, *[r for r in order if r not in half]][:60]
    assert sorted((r["row_id"], r["label"]) for r in got) == sorted(want)
    assert sum(r["label"] for r in got) == min(few, 30) and len(got) == 60


def test_second_truncation_reaches_the_closing_bound(spark):
    ev = spark.createDataFrame([(1, 10_400_000)], "audit_id int, us bigint")
    sp = spark.createDataFrame([(5, 0, 0, 10_000_000)],
                               "session int, pos int, start_us bigint, end_us bigint")
    assert J.session_span(ev, sp).count() == 0
    assert J.session_span(ev, sp, "second").first()["span_session"] == 5


def test_leak_anti_touches_attacks_only(spark):
    tr = spark.createDataFrame([(1, 0.50001, 1), (2, 0.7, 1), (3, 0.5, 0)], "id int, f double, label int")
    ho = spark.createDataFrame([(9, 0.5, 1), (8, 0.7, 0)], "id int, f double, label int")
    assert {r["id"] for r in J.leak_anti(tr, ho, ["f"]).collect()} == {2, 3}
    # After it no train attack equals a held-out attack.
    left = J.leak_anti(tr, ho, ["f"])
    assert J.novel_anti(ho.where("label = 1"), left, ["f"]).count() == 1


def test_alignment(spark):
    a = spark.createDataFrame([(1, 0), (2, 1)], "row_id int, label int")
    J.assert_aligned(a, a)
    for bad in ([(1, 0)], [(1, 0), (2, 0)], [(1, 0), (2, 1), (3, 1)]):
        with pytest.raises(ValueError):
            J.assert_aligned(a, spark.createDataFrame(bad, "row_id int, label int"))


def test_dedup_keeps_first_and_all_blanks(spark):
    rows = [("a", 2, 1), ("a", 1, 2), ("", 1, 3), ("", 1, 4), ("", 1, 4), (None, 5, 5), ("b", 3, 6)]
    df = spark.createDataFrame(rows, "id string, us int, n int")
    assert sorted(r["n"] for r in N.dedup_id(df, "id", ["us", "n"]).collect()) == [2, 3, 4, 4, 5, 6]
    assert sorted(r["n"] for r in N.dedup_id(df, "id", ["us"]).collect()) == [2, 3, 4, 4, 5, 6]


def test_allowlist_is_anchored(spark):
    df = spark.createDataFrame([("ci-deployer",), ("ci-deployer-evil",), ("x-ci-deployer",),
                                ("system:node:n1",), ("evil:system:node:n1",)], "u string")
    got = [r[0] for r in df.select(N.allowed(F.col("u"))).collect()]
    assert got == [True, False, False, True, False]


def test_tool_rules_are_ordered(spark):
    users = ["redteam-stratus-adversary-imp", "adversary-persistsyn-1", "redteam-persist-1", "bob",
             "x-peirates", "adversary-impv-1"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in users], "u string").select(
        N.tool_label(F.col("u"))).collect()]
    assert got == ["stratus", "persistsyn", "persistence", "synthetic", "peirates", "impact"]


def test_parts(spark):
    rows = [("lateral", "adversary-lat-1", 1, "train"), ("lateral", "adversary-lat-9", 1, "lateral_eval"),
            ("impact", "adversary-impv-2", 9, "train"), ("impact", "adversary-impv-9", 9, "impact_eval"),
            ("impact", "adversary-imp-9", 9, "drop"), ("evasion", "adversary-eva-9", 9, "drop"),
            ("synthetic", "ns:recon-sa", 5, "recon_eval"), ("synthetic", "ns:recon-sa", 1, "train_recon_excl"),
            ("synthetic", "bob", 6, "test"), ("synthetic", "bob", 7, "train"),
            ("rakkess", "redteam-rakkess", 1, "recon_eval"), ("stratus", "x", 1, "stratus_eval")]
    df = spark.createDataFrame(rows, "tool string, user string, session int, want string")
    out = df.withColumn("got", SP.tool_part(F.col("tool"), F.col("user"), F.col("session")))
    assert out.where("got <> want").count() == 0


@pytest.mark.parametrize("parts", [1, 9])
def test_splits_do_not_depend_on_partitioning(spark, parts):
    df = spark.range(1001).select(
        F.col("id").alias("row_id"), (F.col("id") % 4 == 0).cast("int").alias("label"),
        (F.col("id") * 1000).alias("us"), F.col("id").alias("audit_id")).repartition(parts)
    strat = SP.stratified_split(df)
    by = {(r["label"], r["split"]): r["count"] for r in strat.groupBy("label", "split").count().collect()}
    assert by == {(0, "train"): 600, (0, "test"): 150, (1, "train"): 200, (1, "test"): 51}
    checksum = strat.where("split = 'test'").agg(F.sum("row_id")).first()[0]
    again = SP.stratified_split(df.repartition(3)).where("split = 'test'")
    assert again.agg(F.sum("row_id")).first()[0] == checksum
    half = SP.halves(df, bucket_rows=37)
    assert half.where("half = 'calibration'").agg(F.count("row_id"), F.max("row_id")).first()[:] == (500, 499)
    time = SP.time_fraction(df, 0.7, bucket_us=7_000)
    assert time.where("split = 'train'").agg(F.count("us"), F.max("row_id")).first()[:] == (700, 699)
    sample = SP.sample_stratified(df, 600)
    assert {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()} == {0: 349, 1: 251}


def test_vocabulary_and_encoding(spark):
    df = spark.createDataFrame([(1, ["<PAD>", "b", "a"]), (2, ["zz", "é", "b"])], "id int, tokens array<string>")
    vocab = SP.vocabulary(df.where("id = 1").select(F.explode("tokens").alias("token")).where("token <> '<PAD>'"))
    assert {r["token"]: r["id"] for r in vocab.collect()} == {"<PAD>": 0, "<UNK>": 1, "a": 2, "b": 3}
    for limit in (1000, 1):  # map literal, then join
        got = {r["id"]: r["token_ids"] for r in SP.encode_tokens(
            df, vocab, ["id"], literal_rows=limit).collect()}
        assert got == {1: [0, 3, 2], 2: [1, 1, 3]}


def test_strata_gate(spark):
    rows = [("recon", h) for h in ["train"] * 3 + ["test"] * 4] + [("stolen-token", "train"), ("stolen-token", "test"),
                                                                  ("valid-abuse", "train")]
    eps = spark.createDataFrame(rows, "profile string, split string")
    SP.assert_strata(SP.strata_report(eps), ["recon", "stolen-token"])
    with pytest.raises(ValueError):
        SP.assert_strata(SP.strata_report(eps), ["recon", "valid-abuse"])
    with pytest.raises(ValueError):
        SP.assert_strata(SP.strata_report(eps, min_recon=5), ["recon"])


def test_class_weight_is_floored_and_capped(spark):
    def w(p, n):
        df = spark.createDataFrame([(1,)] * p + [(0,)] * n, "label int")
        return SP.class_weight(df).first()["weight"]
    assert (w(4, 2), w(2, 6), w(1, 50)) == (1.0, 3.0, 11.0)
