from pyspark.sql import functions as F

from tracewell.llm import mixing
from tracewell.llm.mixing import mix, source_targets, take_mix
from tracewell.llm.words import word_count


def _plain_targets(sizes, share=1.5, most=2, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    budget, fixed = share * sum(sizes.values()), {}
    while True:
        left = [s for s in names if s not in fixed]
        rate = (budget - sum(fixed.values())) / sum(w[s] for s in left) if left else 0
        over = {s: most * sizes[s] for s in left if rate * w[s] > most * sizes[s]}
        if not over:
            return {**fixed, **{s: rate * w[s] for s in left}}
        fixed.update(over)


def test_targets_and_fair_taking(spark):
    rows = [(i, s, 5 + (i * 7) % 40) for s, n in (("a", 300), ("b", 40), ("ü", 500), ("Z", 900), (None, 60))
            for i in range(n)]
    docs = spark.createDataFrame([(hash((s, i)) % 10**9, s, " ".join(["w"] * z)) for i, s, z in rows],
                                 "doc_id bigint, source string, text string")
    out = mix(docs, "doc_id", "source", word_count(F.col("text"))).collect()
    sizes = {}
    for _, s, z in rows:
        sizes[s] = sizes.get(s, 0) + z
    want, taken = _plain_targets(sizes), {}
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and 0 <= r["taken"] <= 2 * r["size"]
        assert abs(r["target"] - want[r["source"]]) < 1e-6
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"] * r["n"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * 45
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())
    again = mix(docs.repartition(5), "doc_id", "source", word_count(F.col("text"))).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_one_source_cannot_exceed_twice_its_size(spark):
    units = spark.createDataFrame([("a", 10, 1), ("b", 1000, 1)], "source string, size bigint, n bigint")
    got = {r["source"]: r["target"] for r in source_targets(units).collect()}
    assert got["a"] == 20.0 and abs(got["b"] - 1495.0) < 1e-9


def test_odd_rows(odd):
    out = take_mix(odd)
    rows = out.collect()
    assert out.columns == [c for c in odd.columns if c != "copies"] + ["copies"]
    assert all(r["copies"] in (1, 2) and (r["text"] or "").split() for r in rows)
    twice = [r for r in rows if r["doc_id"] == 8]
    assert len(twice) in (0, 2)


def test_no_rows(nothing):
    assert take_mix(nothing).count() == 0
    assert mix(nothing, "doc_id", "source", word_count(F.col("text"))).count() == 0


def test_repeats_are_cut_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(mixing, "REPEATS", 64)
    words = " ".join(["w"] * 10)
    docs = spark.range(1000).select(
        F.when(F.col("id") % 10 == 0, F.col("id")).alias("doc_id"), F.lit("b").alias("source"),
        F.lit(words).alias("text"), (F.col("id") % 3).alias("copies"), F.lit("z").alias("key"))
    docs = docs.unionByName(spark.range(2000).select(
        F.when(F.col("id") % 2 == 0, F.col("id") + 5000).alias("doc_id"), F.lit("a").alias("source"),
        F.lit(words).alias("text"), F.lit(1).alias("copies"), F.lit("y").alias("key")))
    docs = docs.unionByName(spark.range(400).selectExpr(
        "CAST(NULL AS BIGINT) AS doc_id", "'c' AS source", f"'{words}' AS text", "5 AS copies", "'x' AS key"))
    taken, target, n = {}, {}, {}
    for r in mix(docs, "doc_id", "source", word_count(F.col("text"))).collect():
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"] * r["n"]
        n[r["source"]] = n.get(r["source"], 0) + r["n"]
        target[r["source"]] = r["target"]
    assert n == {"a": 2000, "b": 1000, "c": 400}
    assert all(abs(taken[s] - target[s]) <= 20 for s in target)
    out = take_mix(docs)
    kept = {r["source"]: r["words"] for r in out.groupBy("source").agg(
        (F.sum("copies") * 10).alias("words")).collect()}
    assert kept == taken and out.columns == ["doc_id", "source", "text", "key", "copies"]
    assert out.count() <= 3400 and out.where("copies NOT IN (1, 2)").count() == 0
