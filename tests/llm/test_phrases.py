"""Phrases against a plain count of all phrases."""

import random
import re
from collections import Counter

import pytest

from tracewell.llm.phrases import collocations, frequent_pairs, phrase_counts, pieces


def _pieces(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
        yield re.findall(r"[^\x20\x09]+", piece)


def _plain(rows, order, least, top, cover):
    n, f = Counter(), Counter()
    for lang, text in rows:
        for words in _pieces(text):
            n["und" if lang is None else lang] += len(words)
            for size in range(1, order + 1):
                for i in range(len(words) - size + 1):
                    f["und" if lang is None else lang, tuple(words[i:i + size])] += 1
    held = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    most = Counter()
    for (lang, ws), b in held.items():
        for size in range(2, len(ws)):
            for i in range(len(ws) - size + 1):
                most[lang, ws[i:i + size]] = max(most[lang, ws[i:i + size]], b)
    out = []
    for (lang, ws), a in held.items():
        inside = (lang, ws) in most and 100 * most[lang, ws] >= cover * a
        if not inside:
            cuts = [(1000 * a * n[lang] // (f[lang, ws[:k]] * f[lang, ws[k:]]), k) for k in range(1, len(ws))]
            score, k = min(cuts)
            out.append((lang, " ".join(ws), a, f[lang, ws[:k]], f[lang, ws[k:]], n[lang], score))
    ranked = []
    for lang in {o[0] for o in out}:
        mine = sorted([o for o in out if o[0] == lang], key=lambda o: (-o[6], -o[2], o[1].encode()))
        ranked += [(o[0], i + 1, *o[1:]) for i, o in enumerate(mine[:top])]
    return sorted(ranked)


def _rows(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    words = ["New", "york", "the", "of", "city", "é", "😀", "x\x1fy", "zu"]
    out = []
    for i in range(300):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n"])
                       for _ in range(rng.randrange(60)))
        out.append((rng.choice(["en", "en", "de", None, "und", ""]), text))
    # A phrase in a longer one each time, one that overlaps itself, and a very long text without a piece's end.
    out += [("en", "one two three four five six seven")] * 30 + [("de", "so so so so so so so so")] * 10
    out += [("en", "the of " * 20_000), ("en", None), ("fr", ""), ("fr", " .,;\n"), (None, "the")]
    return out


@pytest.mark.parametrize(("order", "least", "top", "cover"), [(5, 20, 2_000, 100), (5, 3, 7, 100), (3, 10, 50, 90), (2, 1, 9, 100)])
def test_against_a_plain_count(spark, rows, order, least, top, cover):
    df = spark.createDataFrame([(la, t, "a", "b") for la, t in rows], "lang string, text string, phrase string, n string")
    got = collocations(df.repartition(5), order=order, least=least, top=top, cover=cover)
    assert _rows(got) == _plain(rows, order, least, top, cover)


def test_products_beyond_64_bits(spark):
    """Counts near 10^12, as a corpus of terabytes has them."""
    from tracewell.llm.phrases import weakest_cuts
    big = 3 * 10**12
    phrases = spark.createDataFrame([("en", 1, "a", big), ("en", 1, "b", big - 1), ("en", 2, "a b", big - 7)],
                                    "lang string, size int, phrase string, f bigint")
    totals = spark.createDataFrame([("en", 10**15)], "lang string, n bigint")
    got = weakest_cuts(phrases, totals).collect()
    assert [r["score"] for r in got] == [1000 * (big - 7) * 10**15 // (big * (big - 1))]


def test_every_frequent_pair_is_kept_and_counts_are_whole(spark, rows):
    df = spark.createDataFrame(rows, "lang string, text string")
    pairs = Counter()
    for lang, text in rows:
        for words in _pieces(text):
            pairs.update(("und" if lang is None else lang, a, b) for a, b in zip(words, words[1:]))
    assert frequent_pairs(pieces(df), 20).count() == sum(n >= 20 for n in pairs.values())
    phrases, totals = phrase_counts(df, least=20)
    assert {(r["lang"], *r["phrase"].split(" ")): r["f"] for r in phrases.where("size = 2").collect()} == {
        k: n for k, n in pairs.items() if n >= 20}
    assert totals.where("lang = 'fr'").count() == 0


def test_empty_table(spark):
    assert collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert collocations(spark.createDataFrame([("en", "a b")], "lang string, text string")).count() == 0
