import random

import numpy as np
from pyspark.sql import functions as F

from tracewell.llm import decontaminate as D


def _fewest(doc, pattern):
    """Edits to the nearest part of the document, by the full table."""
    p = np.frombuffer(pattern, np.uint8)
    col = np.arange(len(p) + 1)
    best, step = len(p), np.arange(len(p) + 1)
    for ch in doc:
        new = np.empty_like(col)
        new[0] = 0
        new[1:] = np.minimum(col[:-1] + (p != ch), col[1:] + 1)
        col = np.minimum.accumulate(new - step) + step
        best = min(best, int(col[-1]))
    return best


def _text(rng, words):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(words))


def _edited(rng, text, rate):
    out = list(text)
    for _ in range(int(rate * len(out))):
        at, kind = rng.randrange(len(out)), rng.random()
        out[at:at + 1] = [] if kind < .3 else ["z"] if kind < .7 else [out[at], "q"]
    return "".join(out)


def test_windows_against_full_alignment():
    rng = random.Random(4)
    items = [(i, D.normalise(_text(rng, n).encode())) for i, n in enumerate((4, 9, 18, 30, 45, 60))]
    bench = D.Benchmark(items)
    texts = []
    for rate in (0, .03, .07, .1, .12) * 3:
        piece = _edited(rng, rng.choice(items)[1].decode(), rate)
        texts.append(f"{_text(rng, 30)} {piece} {_text(rng, 20)}".encode())
    got = D.leaks_of(texts, bench)
    for text, found in zip(texts, got):
        doc = D.normalise(text)
        for k, (_, item) in enumerate(bench.items):
            w = bench.widths[k]
            want = {s for s in D.windows(len(item)) if _fewest(doc, item[s:s + w]) <= D.edit_budget(w)}
            assert found.get(k, (set(), 0))[0] == want


def test_long_text_over_several_slices(monkeypatch):
    monkeypatch.setattr(D, "SLICE_BYTES", 2_000)
    rng = random.Random(8)
    item = _text(rng, 40)
    bench = D.Benchmark([(1, D.normalise(item.encode()))])
    for at in range(300, 700, 13):
        text = f"{_text(rng, at)} {item} {_text(rng, 500)}".encode()
        assert list(D.leaks_of([text], bench)[0]) == [0]


def test_odd_rows(spark, odd, nothing):
    items = spark.createDataFrame(
        [(1, "SOME0  line0 of0, a0 passage0 in0 two0 texts0! some1 line1 of1 a1 passage1"), (2, None),
         (3, ""), (4, "tiny"), (5, D.normalise(b"word1 word2 word3 word4 word5 word6").decode()),
         (5, D.normalise(b"word1 word2 word3 word4 word5 word6").decode()), (None, "漢字 😀 ñandú über ﬁn")],
        "item_id bigint, text string")
    got = odd.select("doc_id", F.inline(D.leaks(odd, items))).collect()
    assert sorted({(r["doc_id"], r["item_id"] or 0) for r in got}) == [(1, 1), (2, 1), (6, 5), (9, 0)]
    kept = D.drop_leaking(odd, items)
    assert kept.columns == odd.columns and kept.count() == 8
    assert D.drop_leaking(odd, items.where("false")).count() == 12
    assert D.drop_leaking(nothing, items).count() == 0


def test_benchmark_in_blocks(spark, odd):
    items = spark.createDataFrame([(i, f"some{i} line{i} of{i} a{i} passage{i} in{i}") for i in range(8)],
                                  "item_id bigint, text string")
    blocks = list(D.benchmark_blocks(items, "item_id", "text", 60))
    assert len(blocks) > 3 and sorted(i for b in blocks for i, _ in b) == list(range(8))
