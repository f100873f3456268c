from math import comb

import pandas as pd
import pytest

from tracewell.llm.quality import (COUNTS, RULES, STEPS, Risk, binomial_below, choose_cutoff, judge, keep_good,
                                   repeated_words, text_counts)


@pytest.mark.parametrize("k,n,p", [(0, 10, .1), (3, 50, .02), (5, 200, .05), (20, 40, .5), (39, 40, .9)])
def test_binomial_tail(k, n, p):
    assert abs(binomial_below(k, n, p) - sum(comb(n, i) * p**i * (1 - p)**(n - i) for i in range(k + 1))) < 1e-12


def test_repeated_words_by_hand():
    words = [b"w%d" % i for i in range(30)]
    assert repeated_words(words) == 0
    assert repeated_words(words + words[:8]) == 16
    assert repeated_words([b"x"] * 8) == 0 and repeated_words([b"x"] * 9) == 9


def test_counts_of_a_text():
    text = "Ab #1! ü\n\nAb #1! ü\n  \nlast|<".encode()
    got = dict(zip(COUNTS, text_counts(text)))
    assert got == {"n_words": 7, "word_chars": 18, "n_symbols": 4, "n_lines": 3, "n_dup_lines": 1,
                   "n_repeat_words": 0, "n_upper": 2, "n_digits": 2, "n_calls": 2, "n_top_word": 2}
    assert text_counts(None) == text_counts(b"  \n") == (0,) * len(COUNTS)


def test_cutoff_is_the_mildest_proven_one():
    steps = pd.DataFrame({"step": [0, 40, 80], "good_hold": [3000, 400, 0], "good_tune": [3000, 400, 0],
                          "bad_tune": [0, 300, 500]})
    assert choose_cutoff(steps, 0.01, 0.001, 0.5) == 41
    assert choose_cutoff(steps, 0.5, 0.001, 0.9) == 41
    few = steps.assign(good_hold=[30, 0, 0])
    assert choose_cutoff(few, 0.01, 0.001, 0.5) == STEPS + 1


def test_false_rejections_are_limited(spark):
    rows, labels = [], []
    for i in range(6000):
        bad = i % 3 == 0
        body = " ".join(f"w{(i * 31 + j * 7) % 5000}a" for j in range(60))
        rows.append((i, (body + " ### $$$ %%%" * 5) if bad else body, "en" if i % 2 else None))
        labels.append((i, 0 if bad else 1))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    marks = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id bigint, quality int")
    out = judge(docs, marks, Risk(risk=0.1)).toPandas()
    assert len(RULES) == len(out["steps"].iloc[0])
    assert out[out["id"] % 3 == 0]["kept"].mean() < 0.1
    assert out[out["id"] % 3 != 0]["kept"].mean() > 0.99


def test_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id bigint, quality int")
    kept = keep_good(odd, labels)
    assert kept.columns == odd.columns
    # The fixture's texts of one repeated phrase, and those of under 20 words, fail the base test.
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2]
    assert keep_good(nothing, labels).count() == 0
    assert judge(odd, labels.where("false")).where("kept").count() == 2
