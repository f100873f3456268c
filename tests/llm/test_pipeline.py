"""The pipeline, stage by stage, against plain models."""

import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from llm.test_linededup import _plain as plain_lines
from llm.test_simhash import _jaccard as jaccard
from llm.test_simhash import _roots
from tracewell.llm import decontaminate as D
from tracewell.llm.mixing import mix
from tracewell.llm.quality import judge
from tracewell.llm.similar import shingle_set
from tracewell.llm.words import word_count


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Input and output of every stage, as the driver runs them."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for i, (name, stage) in enumerate(P.STAGES):
        path = f"{tmp_path_factory.mktemp('stage')}/{i}"
        stage(spark, docs, sf).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs, after))
        docs = after
    return out


def _texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns_stay_until_the_last_stage(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns
    assert stages[-1][1].columns == [*stages[0][0].columns, "copies"]


def test_quality(spark, sf, stages):
    before, after = stages[0]
    kept = judge(before, spark.read.parquet(f"{sf}/labels.parquet")).where("kept").select("id")
    assert sorted(r["id"] for r in kept.collect()) == sorted(_texts(after))
    bad = {r["doc_id"] for r in before.where(word_count(F.col("text")) < 20).collect()}
    assert bad and not bad & set(_texts(after))


def test_line_dedup(stages):
    before, after = stages[1]
    want = plain_lines(_texts(before), 50)
    old = _texts(before)
    want = {d: t for d, t in want.items() if t == old[d] or t.split()}
    assert _texts(after) == want
    assert after.where(F.length("text") != F.col("n_chars")).count() == 0


def test_near_copies(stages):
    before, after = stages[2]
    sets = {d: shingle_set((t or "").encode()) for d, t in _texts(before).items()}
    ids = sorted(sets)
    edges = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if jaccard(sets[a], sets[b]) >= 0.8]
    assert edges
    assert set(_texts(after)) == set(_roots(ids, edges).values())


def test_leaks(spark, sf, stages):
    before, after = stages[3]
    items = [D.normalise(r["text"].encode()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    pieces = [t[s:s + D.SPAN] for t in items for s in D.windows(len(t))]
    leaking = {d for d, t in _texts(before).items() if any(p in D.normalise((t or "").encode()) for p in pieces)}
    gone = set(_texts(before)) - set(_texts(after))
    assert leaking <= gone
    bench = D.Benchmark(list(enumerate(items)))
    for d in gone - leaking:
        assert D.leaks_of([_texts(before)[d].encode()], bench)[0]


def test_mix(stages):
    before, after = stages[4]
    want = {r["doc_id"]: r["copies"] for r in mix(before, "doc_id", "source", word_count(F.col("text"))).collect()}
    assert {r["doc_id"]: r["copies"] for r in after.collect()} == {d: n for d, n in want.items() if n}
    assert np.isin([r["copies"] for r in after.collect()], [1, 2]).all()


def test_run_on_odd_and_empty_tables(spark, sf, odd, nothing, tmp_path):
    for name, docs in (("odd", odd.drop("copies")), ("none", nothing.drop("copies"))):
        folder = f"{tmp_path}/{name}"
        docs.write.parquet(f"{folder}/documents.parquet")
        for t in ("labels", "benchmark"):
            shutil.copy(f"{sf}/{t}.parquet", f"{folder}/{t}.parquet")
        out = P.run(spark, folder)
        assert out.columns == [*docs.columns, "copies"]
        assert {r["doc_id"] for r in out.collect()} <= ({1, 2} if name == "odd" else set())
