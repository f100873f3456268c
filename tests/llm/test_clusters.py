"""Clusters against a plain model, with ties, hot vectors and rows that can't be used."""

import hashlib
import math

import numpy as np
import pytest

from tracewell.llm.clusters import CLUSTERS, LARGEST, back, cluster_vectors, nearest, transform


def test_coefficients_keep_distances_and_sums():
    rng = np.random.default_rng(7)
    x, y = rng.integers(-LARGEST, LARGEST + 1, (2, 50, 64))
    a, b = transform(x), transform(y)
    assert (((a - b) ** 2).sum(axis=1) == 64 * ((x - y) ** 2).sum(axis=1)).all()
    edge = np.full((1, 64), LARGEST)
    assert nearest(transform(edge), transform(-edge))[1].tolist() == [64 * 4 * LARGEST ** 2]
    for n in (1, 3, 50):
        assert back(a[:n].sum(axis=0).tolist(), n) == [math.floor(s / n) for s in x[:n].sum(axis=0).tolist()]


@pytest.mark.parametrize("spread", [1, 3, 300])
def test_search_against_all_distances(spread):
    rng = np.random.default_rng(spread)
    x = rng.integers(-spread, spread + 1, (3_000, 64))
    c = rng.integers(-spread, spread + 1, (40, 64))
    c[9] = c[4]
    x[:500] = c[rng.integers(0, 40, 500)]
    number, distance = nearest(transform(x), transform(c))
    all_of_them = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert (number == all_of_them.argmin(axis=1)).all()
    assert (distance == all_of_them.min(axis=1)).all()


def _plain(rows, clusters, rounds):
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, [max(-LARGEST, min(LARGEST, math.floor(256 * x))) for x in v]))
    keys = [(i is None, hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "", v) for i, v in kept]
    centroids = [v for *_, v in sorted(keys)[:clusters]]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        where = assign()
        for k in range(len(centroids)):
            mine = [v for (_, v), (c, _) in zip(kept, where) if c == k]
            if mine:
                centroids[k] = [sum(x) // len(mine) for x in zip(*mine)]
    where = assign()
    per = {k: sum(d for c, d in where if c == k) for k, _ in where}
    return sorted([(str(i), c, d, per[c], sum(per.values()),
                    hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
                   for (i, _), (c, d) in zip(kept, where)])


def _rows(df):
    return sorted((str(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"])
                  for r in df.collect())


@pytest.fixture(scope="module")
def odd_vectors():
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 1, 64).tolist()) for i in range(120)]
    rows += [(i, [0.5] * 64) for i in range(200, 260)]  # a hot vector
    rows += [(5, [0.25] * 64), (5, [0.25] * 64), (None, [1.0] * 64)]
    rows += [(300, None), (301, []), (302, [1.0] * 63), (303, [None] + [1.0] * 63), (304, [math.nan] * 64),
             (305, [math.inf] + [0.0] * 63), (306, [1e300] * 64), (307, [-1e9] * 64), (308, [-0.0001] * 64)]
    return rows


@pytest.mark.parametrize("clusters", [3, CLUSTERS])
def test_against_a_plain_model(spark, odd_vectors, clusters):
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in odd_vectors],
                               "vec_id bigint, embedding array<double>, cluster string, n string").repartition(4)
    assert _rows(cluster_vectors(df, clusters=clusters)) == _plain(odd_vectors, clusters, 5)


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [0.1] * 64), (2, [0.2] * 64)], "vec_id bigint, embedding array<float>")
    got = _rows(cluster_vectors(df))
    assert [(g[0], g[2], g[4]) for g in got] == [("1", 0, 0), ("2", 0, 0)]
    assert cluster_vectors(df.where("false")).count() == 0
