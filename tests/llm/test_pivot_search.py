"""The near-dedup stage searches by fingerprints and pivot tables; the sets decide."""

from pyspark.sql import functions as F

from llm.test_simhash import _roots
from tracewell.llm import simhash as simhash_module
from tracewell.llm.similar import near_copies
from tracewell.llm.simhash import _signed, keep_one_of_each


def test_near_dedup_searches_the_pivot_tables_and_checks_the_sets(spark, monkeypatch):
    """Sets of linked fingerprints are paired; the pipeline's stage asks for them, and the sets decide."""
    prints = [(10, 0), (11, 0), (12, 0), (20, 7), (30, 0xFFFF), (31, 0xFFFF), (40, 0xFFFFFFFF)]
    df = spark.createDataFrame([*prints, (10, 0)], "node bigint, fp bigint")
    pairs = [(r["a"], r["b"]) for r in simhash_module.linked_sets(df).collect()]
    assert _roots([n for n, _ in prints], pairs) == {10: 10, 11: 10, 12: 10, 20: 10, 30: 30, 31: 30, 40: 40}
    assert {frozenset(p) for p in pairs} == {frozenset(p) for p in [(10, 11), (10, 12), (10, 20), (30, 31)]}
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words), " ".join([*words[:-1], "x"]), " ".join(f"v{i}" for i in range(200))]
    asked, real = [], simhash_module.links

    def seen(nodes, *args):
        asked.append({r["fp"] for r in nodes.collect()})
        return real(nodes, *args)

    monkeypatch.setattr(simhash_module, "links", seen)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in keep_one_of_each(docs).collect()) == [0, 2]
    assert len(asked) == 1 and asked[0] == {
        _signed(simhash_module.simhash(simhash_module.shingle_hashes(t.encode().split()))) for t in texts}


def test_pairs_of_the_search_are_decided_by_their_sets(spark):
    """A pair that the search brings in is linked at 0.8 only."""
    texts = ["a b c d e f", "a b c d e g", "p q r s t u"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    every = lambda p: p.select(F.col("node").alias("a")).crossJoin(p.select(F.col("node").alias("b")))
    found = near_copies(docs, fp=F.lit(0).cast("bigint"), search=every).collect()
    assert len({r["root"] for r in found}) == 3
