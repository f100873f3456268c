import numpy as np
import pytest

from pyspark.sql import functions as F
from tracewell.models import learners as L
from tracewell.models import network as N
from tracewell.operators import aggregates as A
from tracewell.plans.catalog import QUERIES


def _newton(x, y):
    """Unit-penalty logistic fit, intercept free."""
    a = b = 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-(a * x + b)))
        g = np.array([(x * (p - y)).sum() + a, (p - y).sum()])
        w = p * (1 - p)
        h = np.array([[(w * x * x).sum() + 1, (w * x).sum()], [(w * x).sum(), w.sum()]])
        da, db = np.linalg.solve(h, g)
        a, b = a - da, b - db
    return a, b


def test_platt_matches_newton(spark):
    rng = np.random.default_rng(2)
    y = (rng.random(300) < 0.4).astype(int)
    x = np.round(np.clip(0.3 + 0.4 * y + rng.normal(0, 0.2, 300), 0, 1), 2)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "prob double, label int")
    assert L.fit_platt(df, "prob") == pytest.approx(_newton(x, y), abs=1e-4)


def _planted(spark, n=600):
    rng = np.random.default_rng(4)
    y = (rng.random(n) < 0.3).astype(int)
    x = rng.normal(0, 1, (n, 3)) + 1.5 * y[:, None] * np.array([1, 0.5, 0])
    return spark.createDataFrame(
        [(i, *map(float, r), int(l)) for i, (r, l) in enumerate(zip(x, y))],
        "row_id int, a double, b double, c double, label int")


def test_boosted_trees_find_the_signal_and_reload(spark, tmp_path):
    df = _planted(spark)
    feats = ["a", "b", "c"]
    model = L.fit_tabular(df, feats, L.gbt(10))
    scored = L.score(model, df)
    m = L.metrics_row(scored).first()
    assert m["recall"] > 0.6 and m["fpr"] < 0.2 and m["roc_auc"] > 0.85
    gap = scored.groupBy("label").agg(F.avg("prob").alias("p")).orderBy("label").collect()
    assert gap[1]["p"] - gap[0]["p"] > 0.3
    assert L.top_importances(L.importances(model, feats, spark), 1).first()["feature"] == "a"
    L.save_artifact(model, str(tmp_path / "m"), {"features": feats}, spark)
    again, cfg = L.load_artifact(str(tmp_path / "m"), spark)
    assert cfg == {"features": feats}
    assert L.rescoring_gap(scored, L.score(again, df), "row_id").first()[:] == (600, 0.0)


def test_reconstruction_error(spark):
    rng = np.random.default_rng(1)
    basis = rng.normal(size=(2, 6))
    x = rng.normal(size=(200, 2)) @ basis
    odd = rng.normal(size=(20, 6)) * 3
    rows = [(i, int(i >= 200), *map(float, r)) for i, r in enumerate(np.vstack([x, odd]))]
    feats = [f"f{i}" for i in range(6)]
    df = spark.createDataFrame(rows, "row_id int, label int, " + ", ".join(f"{f} double" for f in feats))
    benign = df.where("label = 0")
    sc = L.fit_scaler(benign, feats)
    pc = L.fit_components(L.apply_scaler(benign, sc), feats, k=2)
    err = L.reconstruction_error(L.apply_scaler(df, sc), feats, pc).cache()
    t = L.error_threshold(err.where("label = 0"))
    out = L.anomaly_scores(err, max(t, 1e-9))
    assert out.where("label = 1 AND ae_pred = 1").count() == 20
    assert out.where("label = 0").agg(F.max("mse")).first()[0] < 1e-9


def test_scaler_uses_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    out = L.apply_scaler(df, L.fit_scaler(df, ["a", "b"])).collect()
    assert [tuple(r) for r in out] == [(-1.0, 0.0), (1.0, 0.0)]


def test_weight_sweep_end_is_the_single_model(spark):
    df = _planted(spark).select("label", (1 / (1 + F.exp(-F.col("a")))).alias("a"),
                                (1 / (1 + F.exp(-F.col("c")))).alias("b"))
    out = {r["w"]: r for r in L.weight_sweep(df, "a", "b", [0.5, 1.0]).collect()}
    from tracewell.operators.evaluate import auc, score_points
    alone = auc(score_points(df.withColumnRenamed("a", "prob"))).first()["roc_auc"]
    assert out[1.0]["roc_auc"] == pytest.approx(alone)


def test_bootstrap_interval_covers_the_rate_and_repeats(spark):
    g = spark.createDataFrame([("recall", 39, 52), ("fpr", 0, 10)], "metric string, hits int, total int")
    a = {r["metric"]: r for r in A.bootstrap_ci(g, "metric", "hits", "total", 2000).collect()}
    b = {r["metric"]: r for r in A.bootstrap_ci(g.repartition(5), "metric", "hits", "total", 2000).collect()}
    assert a == b and a["recall"]["resamples"] == 2000
    assert a["recall"]["low"] == pytest.approx(0.63, abs=0.03)
    assert a["recall"]["high"] == pytest.approx(0.86, abs=0.03)
    assert a["fpr"]["low"] == a["fpr"]["high"] == 0.0


def test_balance_and_selection(spark):
    df = spark.createDataFrame([(1,)] * 3 + [(0,)] * 10, "label int")
    assert {r["label"]: r["count"] for r in L.balance_copies(df).groupBy("label").count().collect()} == {
        1: 9, 0: 10}
    p = _planted(spark, 300)
    rows = L.select_model(p, p, p, ["a", "b"], [("d1", L.gbt(3, 1)), ("d3", L.gbt(3, 3))])
    assert sum(r["selected"] for r in rows) >= 1


def _plain_network(w, layers, x, y):
    """Mean loss and gradient of Spark's weights, all rows at once in double precision."""
    acts, mats, at = [x], [], 0
    for n, k in zip(layers, layers[1:]):
        mats.append((w[at:at + n * k].reshape(n, k), w[at + n * k:at + (n + 1) * k]))
        at += (n + 1) * k
        acts.append(acts[-1] @ mats[-1][0] + mats[-1][1])
        if len(mats) < len(layers) - 1:
            acts[-1] = 1 / (1 + np.exp(-acts[-1]))
    p = np.exp(acts[-1]) / np.exp(acts[-1]).sum(axis=1, keepdims=True)
    loss, e, out = -np.log(p[np.arange(len(y)), y]).mean(), (p - np.eye(layers[-1])[y]) / len(y), []
    for i in range(len(mats) - 1, -1, -1):
        out = [(acts[i].T @ e).ravel(), e.sum(axis=0), *out]
        if i:
            e = (e @ mats[i][0].T) * acts[i] * (1 - acts[i])
    return loss, np.concatenate(out)


def _crossed(spark, n, parts):
    """Classes that no single feature tells apart."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    df = spark.createDataFrame([(*map(float, r), int(l)) for r, l in zip(x, y)],
                               "a double, b double, c double, label int")
    return x, y, L.assembler(["a", "b", "c"]).transform(df.repartition(parts))


def test_network_pass_sums_every_row_in_even_parts(spark, monkeypatch):
    monkeypatch.setattr(N, "PART_ROWS", 100)
    x, y, df = _crossed(spark, 5000, 3)
    net = L.packet_mlp(["a", "b", "c"], iters=3)
    w = net.carry(spark).weights.toArray() * 3
    blocks = N.row_blocks(df, 3)
    assert blocks.getNumPartitions() == 56
    assert sum(b[1].size for b in blocks.collect()) == 5000
    loss, slope = N.mean_loss(blocks, w, net.layers)
    want, want_slope = _plain_network(w, net.layers, x, y)
    assert loss == pytest.approx(want, rel=1e-5)
    assert slope == pytest.approx(want_slope, abs=1e-6)
    monkeypatch.setattr(N, "FLAT_PARTS", 8)
    assert N.mean_loss(blocks, w, net.layers)[0] == pytest.approx(want, rel=1e-5)
    with pytest.raises(ValueError, match="no rows"):
        net.fit(df.where("label = 7"))


def test_network_fit_is_as_good_as_the_library_fit(spark):
    from pyspark.ml.classification import MultilayerPerceptronClassifier as Library
    _, _, df = _crossed(spark, 2000, 2)
    df = df.cache()
    net = N.BlockPerceptron([3, 8, 2], 40)
    other = Library(layers=net.layers, maxIter=40, seed=0).fit(df)
    model = net.fit(df)
    first = Library(layers=net.layers, maxIter=0, seed=0).fit(df).weights
    assert type(model) is type(other) and net.carry(spark).weights == first
    blocks = N.row_blocks(df, 3)
    loss = [N.mean_loss(blocks, m.toArray(), net.layers)[0] for m in (first, other.weights, model.weights)]
    assert loss[2] < 0.5 * loss[0] and loss[2] < 1.3 * loss[1] + 0.01
    assert L.metrics_row(L.score(model, df)).first()["roc_auc"] > 0.95


def test_minimise_ends_at_the_least_value_and_keeps_to_its_limit():
    calls = []

    def valley(x):
        calls.append(1)
        a, b = x
        return 100 * (b - a * a) ** 2 + (1 - a) ** 2, np.array(
            [-400 * a * (b - a * a) - 2 * (1 - a), 200 * (b - a * a)])

    x, losses = N.minimise(valley, np.array([-1.2, 1.0]), 120, 1e-9)
    assert x == pytest.approx([1, 1], abs=1e-3) and losses == sorted(losses, reverse=True)
    assert len(calls) < 80
    assert len(N.minimise(valley, np.array([-1.2, 1.0]), 5, 1e-9)[1]) == 6


def _cross_tables(spark, folder, attack_is_dear, orders=81):
    """Flows whose price gives the class away, and orders of which the dear ones have status F."""
    flows = [(i, i % 7, i % 5, i % 11, 900.0 + 100 * i, float(i % 50), (i >= 200) == attack_is_dear) for i in range(400)]
    spark.createDataFrame(flows, "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, "
                          "l_extendedprice double, l_quantity double, attack boolean").select(
        "*", F.lit("1998-01-01").cast("date").alias("l_shipdate"),
        F.when(F.col("attack"), "A").otherwise("N").alias("l_returnflag")).write.parquet(f"{folder}/lineitem.parquet")
    rows = [(i, 1000.0 + 500 * i, "F" if i >= 60 else "O") for i in range(80)] + [(80, 40_000.0, None)]
    spark.createDataFrame(rows[:orders], "o_orderkey long, o_totalprice double, o_orderstatus string").write.parquet(
        f"{folder}/orders.parquet")
    return str(folder)


def test_foreign_rows_are_judged_by_the_fitted_model(spark, tmp_path):
    got = {dear: QUERIES["op_cross_dataset"](spark, _cross_tables(spark, tmp_path / str(dear), dear)).first().asDict()
           for dear in (True, False)}
    assert got[True] != got[False]
    assert [(r["positives"], r["negatives"]) for r in got.values()] == [(20, 61)] * 2
    # Half of the orders and the one without a status are dearer than the middle of the flows' prices, 20,900.
    assert [got[True][c] for c in ("tp", "fp", "tn", "fn")] == [20, 21, 40, 0]
    assert [got[False][c] for c in ("tp", "fp", "tn", "fn")] == [0, 40, 21, 20]
    assert got[True]["recall"] == 1 and got[False]["recall"] == 0
    assert got[True]["roc_auc"] > 0.8 and got[False]["roc_auc"] < 0.2


def test_no_foreign_rows_give_zero_counts(spark, tmp_path):
    row = QUERIES["op_cross_dataset"](spark, _cross_tables(spark, tmp_path, True, orders=0)).first()
    assert [row[c] for c in ("positives", "negatives", "tp", "fp", "tn", "fn", "roc_auc")] == [0] * 6 + [None]
