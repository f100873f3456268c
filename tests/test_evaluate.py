import numpy as np
import pytest

from pyspark.sql import functions as F
from tracewell.operators import evaluate as E

PRED = "row_id bigint, prob double, label int"


def _data(n=400, seed=1, ties=True):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.3).astype(int)
    p = np.clip(rng.normal(0.35 + 0.25 * y, 0.2), 0, 1)
    return (np.round(p, 2) if ties else p), y


def _frame(spark, p, y):
    return spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(p, y))], PRED
                                 ).repartition(5)


@pytest.mark.parametrize("ties", [True, False])
def test_auc_and_average_precision(spark, ties):
    p, y = _data(ties=ties)
    got = E.auc(E.score_points(_frame(spark, p, y))).first()
    pos, neg = p[y == 1], p[y == 0]
    pairs = (pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean()
    assert got["roc_auc"] == pytest.approx(pairs, abs=1e-12)
    ap, last = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        rec, prec = (pos >= t).mean(), y[p >= t].mean()
        ap += (rec - last) * prec
        last = rec
    assert got["pr_auc"] == pytest.approx(ap, abs=1e-12)


def test_known_average_precision(spark):
    df = _frame(spark, [0.9, 0.8, 0.7, 0.1], [1, 0, 1, 0])
    assert E.auc(E.score_points(df)).first()["pr_auc"] == pytest.approx(0.8333333333)


def test_operating_point_families(spark):
    p, y = _data()
    pts = E.score_points(_frame(spark, p, y)).cache()
    best = max(((2 * ((p >= t) & (y == 1)).sum() / ((p >= t).sum() + y.sum()), -t)
                for t in set(p)))
    got = E.best_f1(pts).first()
    assert (got["f1"], got["threshold"]) == pytest.approx((best[0], -best[1]))
    ok = [((p >= t)[y == 1].mean(), t) for t in set(p) if (p >= t)[y == 0].mean() <= 0.05]
    r = E.recall_at_fpr(pts, 0.05).first()
    assert r["recall"] == pytest.approx(max(ok)[0])
    ok = [(p >= t)[y == 0].mean() for t in set(p) if (p >= t)[y == 1].mean() >= 0.9]
    assert E.fpr_at_recall(pts, 0.9).first()["fpr"] == pytest.approx(min(ok))


def test_unreachable_fpr_falls_back(spark):
    df = _frame(spark, [0.9, 0.9, 0.5], [0, 1, 1])
    pts = E.score_points(df)
    r = E.recall_at_fpr(pts, 0.01).first()
    assert (r["achieved_fpr"], r["recall"], r["threshold"]) == (0.0, 0.0, None)
    assert E.threshold_at_fpr(pts, 0.01).first()["threshold"] == 0.5


def test_single_class_has_no_area(spark):
    got = E.auc(E.score_points(_frame(spark, [0.1, 0.2], [1, 1]))).first()
    assert got["roc_auc"] is None and got["pr_auc"] == 1.0


def test_threshold_sweep_equals_counting(spark):
    p, y = _data(ties=False)
    for r in E.threshold_sweep(_frame(spark, p, y), [0.1, 0.5, 0.9]).collect():
        t = r["threshold"]
        assert r["tp"] == ((p >= t) & (y == 1)).sum() and r["fn"] == ((p < t) & (y == 1)).sum()
        assert r["fp"] == ((p >= t) & (y == 0)).sum() and r["tn"] == ((p < t) & (y == 0)).sum()


def test_confusion_of_nothing_is_zero(spark):
    r = E.confusion(_frame(spark, [0.1], [0]).where("false")).first()
    assert r["precision"] == 0.0 and r["recall"] == 0.0 and r["fpr"] == 0.0


def test_group_metrics_against_common_pool(spark):
    rng = np.random.default_rng(5)
    ben = np.round(rng.random(200) * 0.8, 2)
    groups = {"g1": np.round(rng.random(30), 2), "g2": np.round(0.5 + rng.random(40) / 2, 2)}
    benign = spark.createDataFrame([(float(v),) for v in ben], "prob double")
    attacks = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs],
                                    "grp string, prob double")
    t1, t5 = np.quantile(ben, 0.99), np.quantile(ben, 0.95)
    out = E.group_metrics(attacks, benign, "grp", list(groups), F.lit(float(t1)), F.lit(float(t5)))
    for r in out.collect():
        v = groups[r["grp"]]
        auc = (v[:, None] > ben).mean() + 0.5 * (v[:, None] == ben).mean()
        assert r["roc_auc"] == pytest.approx(auc) and r["n"] == len(v)
        assert r["recall_fpr1"] == pytest.approx((v >= t1).mean())
        assert r["precision_fpr5"] == pytest.approx(
            (v >= t5).sum() / ((v >= t5).sum() + (ben >= t5).sum()))


def test_ece_puts_one_in_the_last_bin(spark):
    bins = {r["bin"] for r in E.calibration_bins(_frame(spark, [1.0, 0.95, 0.0], [1, 1, 0])).collect()}
    assert bins == {0, 9}
