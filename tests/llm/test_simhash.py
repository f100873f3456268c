import random

import numpy as np
import xxhash

from tracewell.llm.components import components
from tracewell.llm.similar import shingle_set
from tracewell.llm.simhash import keep_one_of_each, linked_rows, links, near_duplicates, simhash


def _roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_pairs(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)]
    edges += [(rng.randrange(5000, 5400), rng.randrange(5000, 5400)) for _ in range(220)] + [(7, 7), (3, 2)]
    want = _roots({n for e in edges for n in e}, edges)
    linked = {n for a, b in edges if a != b for n in (a, b)}
    got = {r["node"]: r["root"] for r in components(
        spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {n: got.get(n, n) for n in linked} == {n: want[n] for n in linked}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def _jaccard(a, b):
    """One for two empty sets."""
    same = len(np.intersect1d(a, b))
    return same / (len(a) + len(b) - same) if len(a) + len(b) else 1.0


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_against_all_pairs_with_crowded_buckets(spark):
    rng = random.Random(9)
    prints = {rng.getrandbits(64) for _ in range(300)}
    for center in [rng.getrandbits(64) for _ in range(4)]:
        for _ in range(150):
            x = center
            for b in rng.sample(range(64), rng.randrange(7)):
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints | {0, (1 << 64) - 1})
    f = np.array(prints, np.uint64)
    edges = [(a, b) for i, a in enumerate(prints)
             for b in f[np.flatnonzero(np.bitwise_count(f[i + 1:] ^ f[i]) <= 3) + i + 1].tolist()]
    want = _roots(prints, edges)
    df = spark.createDataFrame([(_signed(x), 0, _signed(x)) for x in prints], "fp bigint, check bigint, node bigint")
    for bucket in (2048, 8):
        found = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in links(df, 3, bucket).collect()]
        assert set(found) <= {e for a, b in edges for e in ((a, b), (b, a))} | {
            (a, b) for a, b in found if want[a] == want[b]}
        assert _roots(prints, found) == want


def test_second_fingerprint_is_asked_too(spark):
    rows = [(1, 0, 10), (3, 0, 11), (7, 0xFFFF, 12), (15, 0xFFFE, 13)]
    df = spark.createDataFrame(rows, "fp bigint, check bigint, node bigint")
    roots = _roots([10, 11, 12, 13], [(r["a"], r["b"]) for r in links(df, 3, check_bits=9).collect()])
    assert roots == {10: 10, 11: 10, 12: 12, 13: 12}


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(12)
    texts, n = [], 0
    for g in range(30):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(150, 400))]
        texts.append((n, " ".join(words), g))
        n += 1
        for _ in range(3):
            near = list(words)
            near[rng.randrange(len(near))] = "changed"
            texts.append((n, " ".join(near), g))
            n += 1
    df = spark.createDataFrame(texts, "doc_id bigint, text string, g int")
    kept = keep_one_of_each(df).collect()
    assert {r["g"] for r in kept} == set(range(30)) and len(kept) <= 33


def test_fingerprint_by_hand():
    hashes = [xxhash.xxh64_intdigest(t, 42) for t in (b"a b c", b"b c d", b"c d e", b"d e f")]
    want = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > 4)
    assert simhash(np.array(hashes, np.uint64)) == want
    assert simhash(np.tile(np.array(hashes, np.uint64), 700)) == want
    assert simhash(np.zeros(0, np.uint64)) == 0
    assert list(linked_rows(np.array([1, 1, 2]), np.array([0, 7, 7], np.uint64), 3)) == [0, 0, 2]


def test_odd_rows(odd, nothing):
    got = near_duplicates(odd).collect()
    assert len(got) == 12
    empty = {r["doc_id"]: r["component_id"] for r in got if r["fp"] == 0}
    assert empty == {3: 3, 4: 3, 5: 3}
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None, None]
    kept = keep_one_of_each(odd)
    assert kept.columns == odd.columns
    # Texts with an exact similarity of 0.8 over five words hang together, whatever their ids are.
    rows = [(r["doc_id"] is None, r["doc_id"] or 0, shingle_set((r["text"] or "").encode())) for r in odd.collect()]
    edges = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows))
             if _jaccard(rows[i][2], rows[j][2]) >= 0.8]
    roots = _roots(range(len(rows)), edges)
    want = sorted(min(rows[i][:2] for i in roots if roots[i] == r) for r in set(roots.values()))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == want
    assert near_duplicates(nothing).count() == 0 and keep_one_of_each(nothing).count() == 0
