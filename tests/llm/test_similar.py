"""Near copies against the exact similarity of all pairs."""

import random

import numpy as np

from llm.test_simhash import _jaccard, _roots
from tracewell.llm.similar import _distance, near_copies, parity, prefix, shingle_set
from tracewell.llm.simhash import keep_one_of_each


def _texts():
    """Texts with edits around a similarity of 0.8, and all with a common passage."""
    rng, texts = random.Random(5), []
    passage = [f"common{i}" for i in range(30)]
    for _ in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(20, 200))]
        for edits in (0, 1, 2, 3, 4):
            near = list(words)
            for at in rng.sample(range(len(near)), min(len(near), edits * len(near) // 90)):
                near[at] = f"z{rng.randrange(10**6)}"
            texts.append(" ".join([*near, *passage] if edits % 2 else near))
    return texts + ["one two", "one two", "", " \n"]


def test_components_equal_those_of_all_pairs(spark):
    texts = _texts()
    sets = [shingle_set(t.encode()) for t in texts]
    edges = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts))
             if _jaccard(sets[i], sets[j]) >= 0.8]
    want = set(_roots(range(len(texts)), edges).values())
    near = [_jaccard(sets[i], sets[j]) for i in range(200) for j in range(i + 1, 200)]
    assert sum(0.8 <= x < 0.9 for x in near) > 20 and sum(0.7 <= x < 0.8 for x in near) > 20
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r["doc_id"] for r in keep_one_of_each(df).collect()} == want


def test_prefixes_of_similar_sets_share_a_shingle():
    rng = np.random.default_rng(3)
    for n in range(1, 60):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for gone in range(n // 5 + 1):
            b = np.delete(a, rng.choice(len(a), gone, replace=False))
            common = np.unique(rng.choice(a, n // 2 + 1))
            rank = rng.permutation(len(common))
            if len(b) and _jaccard(a, b) >= 0.8:
                assert len(np.intersect1d(prefix(a, common, rank, 0.8), prefix(b, common, rank, 0.8)))


def _signed(rows):
    return rows.view(np.int64).tolist()


def test_bitmaps_never_differ_more_than_their_sets(spark):
    rng, rows = np.random.default_rng(11), []
    for i in range(400):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 400), dtype=np.uint64))
        b = np.union1d(np.delete(a, rng.choice(len(a), rng.integers(0, len(a) // 5 + 1), replace=False)),
                       rng.integers(0, 1 << 63, rng.integers(0, len(a) // 5 + 1), dtype=np.uint64))
        rows.append((i, _signed(parity(a)), _signed(parity(b)), len(np.setxor1d(a, b)), len(a) + len(b)))
    df = spark.createDataFrame(rows, "i int, x array<bigint>, y array<bigint>, apart int, n int")
    got = df.select("x", "y", "apart", "n", _distance("x", "y").alias("d"), _distance("y", "x").alias("e")).collect()
    assert len({(len(r["x"]), len(r["y"])) for r in got if len(r["x"]) != len(r["y"])}) > 1
    assert all(r["d"] == r["e"] <= r["apart"] and (r["apart"] - r["d"]) % 2 == 0 for r in got)
    far = [r for r in got if r["apart"] > r["n"] / 6]
    assert far and sum(9 * r["d"] > r["n"] for r in far) > 0.7 * len(far)


def test_hot_shingle_copies_nulls_and_clashing_columns(spark):
    """One passage in all texts, a third of them copies of one text, some rows repeated whole."""
    rng = random.Random(17)
    passage = " ".join(f"common{i}" for i in range(40))
    rows = [(i, passage + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(12)))) for i in range(240)]
    rows += [(300 + i, passage + " the same end") for i in range(120)]
    rows += [(300, passage + " the same end")] * 3 + [(None, passage), (None, passage), (None, None), (500, None), (501, "")]
    full = [(d, t, "h", "node", f"x{i}") for i, (d, t) in enumerate(rows)]
    df = spark.createDataFrame(full, "doc_id bigint, text string, h string, node string, root string").repartition(7)
    sets = [shingle_set((t or "").encode()) for _, t in rows]
    edges = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if _jaccard(sets[i], sets[j]) >= 0.8]
    roots = _roots(range(len(rows)), edges)
    got = {}
    for r in near_copies(df).select("doc_id", "text_hash", "root").collect():
        got.setdefault(r["root"], []).append(r["doc_id"])
    want = {}
    for i, r in roots.items():
        want.setdefault(r, []).append(rows[i][0])
    key = lambda ids: sorted((x is None, x or 0) for x in ids)
    assert sorted(map(key, got.values())) == sorted(map(key, want.values()))
    kept = keep_one_of_each(df)
    assert kept.columns == df.columns
    first = sorted(map(tuple, kept.collect()), key=str)
    assert len(first) == len(want)
    assert sorted(map(tuple, keep_one_of_each(df.repartition(3)).collect()), key=str) == first
