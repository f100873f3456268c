"""Rule sets that are proven together."""

import numpy as np
import pandas as pd

from tracewell.llm.quality import binomial_below, judge, proven_steps, rule_path


def test_path_takes_most_bad_per_good_first():
    steps = pd.DataFrame({"rule": [0, 0, 0, 1, 1], "step": [10, 50, 90, 20, 60], "good": [90, 1, 0, 100, 0],
                          "bad": [5, 20, 10, 0, 7]})
    assert rule_path(steps, 0.8) == [(0, 50), (1, 60)]


def test_steps_are_proven_up_to_the_whole_risk():
    # Of 400 good documents 2 go at step 0, 6 more at step 1, 20 more at step 2.
    first, counts = np.array([0, 1, 2, 3]), np.array([2, 6, 20, 372])
    assert binomial_below(8, 400, .05) <= .0125 < binomial_below(28, 400, .05)
    assert proven_steps(first, counts, 3, .05, .0125) == 2
    assert proven_steps(np.array([3]), np.array([60]), 3, .05, .0125) == 0
    assert proven_steps(np.array([3]), np.array([100]), 3, .05, .0125) == 3


def test_few_labels_are_enough(spark):
    rows, labels = [], []
    for i in range(1600):
        bad = i % 4 == 0
        body = " ".join(f"w{(i * 31 + j * 7) % 5000}a" for j in range(60))
        rows.append((i, (body + " ### $$$ %%%" * 5) if bad else body, ("en", "de", "fr", "es")[i // 4 % 4]))
        labels.append((i, 0 if bad else 1))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    out = judge(docs, spark.createDataFrame(labels, "doc_id bigint, quality int")).toPandas()
    assert out[out["id"] % 4 == 0].groupby("stratum")["kept"].mean().max() < 0.1
    assert out[out["id"] % 4 != 0].groupby("stratum")["kept"].mean().min() > 0.95
