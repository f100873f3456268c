import math
import zlib
from collections import Counter

import pytest

from tracewell.llm.lm import score_texts


def _plain(docs, order, prior):
    """Counts in dictionaries; every probability by the recursion."""
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    tokens = [[b" ^", *(t or "").encode().translate(low).split(), b" $"] for _, t in docs]
    out = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in docs]
    c = [Counter() for _ in range(order + 1)]
    for w, held in zip(tokens, out):
        for m in range(1, order + 1) if not held else ():
            c[m].update(tuple(w[k - m + 1:k + 1]) for k in range(m - 1, len(w)))
    n = sum(v for k, v in c[1].items() if k != (b" ^",))
    v = len(c[1]) - (1 if n else 0)

    def p(w, h):
        if not h:
            return (c[1][(w,)] + .1) / (n + .1 * (v + 1))
        return (c[len(h) + 1][(*h, w)] + prior * p(w, h[1:])) / (c[len(h)][h] + prior)

    for (i, _), w, held in zip(docs, tokens, out):
        yield (i, held, len(w) - 1, sum(c[1][(x,)] > 0 for x in w[1:]), n,
               sum(math.log10(p(x, ())) for x in w[1:]),
               sum(math.log10(p(w[k], tuple(w[max(0, k - order + 1):k]))) for k in range(1, len(w))))


@pytest.mark.parametrize("order,block", [(1, 10_000), (2, 3_000), (3, 2_000)])
def test_against_plain_counts(spark, odd, order, block):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    rows += [(100 + i, " ".join(f"W{(i * j) % 13}" for j in range(i % 9))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = score_texts(df, order=order, prior=3.0, block_bytes=block).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[2])
    got = sorted(((r["id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"],
                   r["score"]) for r in got), key=key)
    want = sorted(_plain(rows, order, 3.0), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_held_out_texts_gain_from_the_model(spark, sf):
    rows = score_texts(spark.read.parquet(f"{sf}/documents.parquet")).where("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_no_rows(nothing, spark):
    assert score_texts(nothing).count() == 0
    lone = spark.createDataFrame([(None, "only held out")], "doc_id bigint, text string")
    assert [r["train_tokens"] for r in score_texts(lone).collect()] == [0]
