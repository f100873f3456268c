"""Queries of the Spark ML steps. Fits are checked by rows; score algebra has SQL counterparts.

Boosted fits have fewer trees here than the default of 200 (the README has the times); every fit reads the
whole training table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import constants as K
from tracewell.models import learners as L
from tracewell.operators import evaluate as E
from tracewell.operators import flow as FL
from tracewell.operators import splits as SP
from tracewell.operators.joins import leak_anti
from tracewell.operators.normalize import is_recon, keep_deletion_positives
from tracewell.plans import sqltext as Q
from tracewell.plans import views as V
from tracewell.plans.q_windows import scored_windows, token_table
from tracewell.plans.registry import query
from tracewell.session import materialize, scratch_path, written_table

FEATS = K.EVAL_FEATURES
TREES = 10


def train_table(df):
    """Leakage-free, de-duplicated training vectors."""
    train = df.where((F.col("part") == "train") & ~is_recon(F.col("uid")))
    train = keep_deletion_positives(train)
    held = df.where(F.col("part").isin(K.HELD_OUT_PARTS))
    return SP.dedup_vectors(leak_anti(train, held, FEATS), FEATS)


def prepared(spark, sf):
    return written_table(scored_windows(spark, sf).drop("prob"), "windows")


def trained(spark, sf, learner=None):
    df = prepared(spark, sf)
    train = written_table(train_table(df), "train")
    return df, train, L.fit_tabular(train, FEATS, learner or L.gbt(TREES))


def fitted(spark, sf):
    df, _, model = trained(spark, sf)
    return df, model


def held_out(df):
    return df.where(~F.col("part").isin("train", "drop", "train_recon_excl"))


# Area that a fit reaches on its own training rows; a constant model has 0.5.
LEARNED = 0.6


def outcome(model, rows, train):
    """What another engine can tell of a fit: the rows that were scored, and that it learned.

    On the given tables labels follow hashes of ids, so areas on held-out tools stay near a half for any model.
    """
    area = L.metrics_row(L.score(model, train)).first()["roc_auc"]
    return L.metrics_row(L.score(model, rows)).select(
        (F.col("tp") + F.col("fn")).alias("positives"), (F.col("fp") + F.col("tn")).alias("negatives"),
        (F.lit(area) >= LEARNED).alias("learned"))


_COUNTS = """SELECT CAST(count(*) FILTER (WHERE label = 1) AS BIGINT) AS positives,
  CAST(count(*) FILTER (WHERE label = 0) AS BIGINT) AS negatives, true AS learned"""
_HELD_OUT = f"""WITH {Q.LABELLED} {_COUNTS} FROM lab1
  WHERE part NOT IN ('train', 'drop', 'train_recon_excl')"""


@query("ml_gbt_train", _HELD_OUT)
def ml_gbt_train(spark, sf):
    df, train, model = trained(spark, sf)
    return outcome(model, held_out(df), train)


@query("ml_gbt_alt", _HELD_OUT)
def ml_gbt_alt(spark, sf):
    df, train, model = trained(spark, sf, L.forest())
    return outcome(model, held_out(df), train)


@query("ml_score", f"WITH {Q.LABELLED} SELECT audit_id, part, true AS in_range FROM lab1")
def ml_score(spark, sf):
    df, model = fitted(spark, sf)
    return L.score(model, df).select("audit_id", "part", F.col("prob").between(0, 1).alias("in_range"))


@query("ml_importance", "SELECT feature, true AS non_negative, true AS sums_to_one FROM (SELECT UNNEST(["
       + Q.names(FEATS) + "]) AS feature)")
def ml_importance(spark, sf):
    _, model = fitted(spark, sf)
    imp = L.importances(model, FEATS, spark)
    total = imp.agg(F.sum("importance")).first()[0]
    return imp.select("feature", (F.col("importance") >= 0).alias("non_negative"),
                      F.lit(abs(total - 1) < 1e-9).alias("sums_to_one"))


@query("op_topk_importance", "SELECT CAST(8 AS BIGINT) AS features, true AS above_the_rest")
def op_topk_importance(spark, sf):
    _, model = fitted(spark, sf)
    imp = L.importances(model, FEATS, spark)
    top = L.top_importances(imp, 8)
    rest = imp.join(top.select("feature"), "feature", "left_anti").agg(F.max("importance")).first()[0]
    return top.agg(F.count(F.lit(1)).alias("features"), (F.min("importance") >= rest).alias("above_the_rest"))


@query("sink_model_artifact", f"""WITH {V.AUDIT} SELECT CAST(count(*) AS BIGINT) AS rows,
  CAST(0 AS DOUBLE) AS max_gap FROM audit""")
def sink_model_artifact(spark, sf):
    df, model = fitted(spark, sf)
    path = scratch_path(spark, "artifact")
    L.save_artifact(model, path, {"features": FEATS, "thresholds": {"prob": 0.5, "K": 2}}, spark)
    again, _ = L.load_artifact(path, spark)
    return L.rescoring_gap(L.score(model, df), L.score(again, df), "audit_id")


ABLATION = {
    "full": FEATS,
    "no_cumulative": [f for f in FEATS if not f.startswith("cum_")],
    "no_presence": [f for f in FEATS if not f.startswith("has_")],
    "only_counts": [f for f in FEATS if f.startswith("n_")],
}


@query("ml_ablation")
def ml_ablation(spark, sf):
    df = prepared(spark, sf)
    return L.ablation(train_table(df), materialize(held_out(df)), ABLATION, lambda: L.gbt(5))


@query("ml_model_selection")
def ml_model_selection(spark, sf):
    df = prepared(spark, sf)
    new = df.where(F.col("part").isin("stratus_eval", "peirates_eval", "test"))
    rows = L.select_model(train_table(df), new, df.where(F.col("part") == "train"), FEATS,
                          [("depth2", L.gbt(5, 2)), ("depth4", L.gbt(5, 4)), ("forest", L.forest())])
    return spark.createDataFrame(
        [(r["candidate"], r["detection"], r["fpr"], r["old_f1"], r["gain"], r["passes"],
          r["selected"]) for r in rows],
        "candidate string, detection double, fpr double, old_f1 double, gain double, "
        "passes boolean, selected boolean")


FLOW_FEATS = ["duration", "packets_count", "fwd_packets_count", "total_bytes"]


def clean_flows(spark, sf):
    df, feats = FL.load_tabular(V.flows(spark, sf).drop("l_shipdate"), ["source_file"])
    return df.withColumnRenamed("y", "label"), feats


@query("op_cross_dataset", rounded=("roc_auc", "pr_auc"))
def op_cross_dataset(spark, sf):
    """Train on flows, score orders recast as flows that lack two of the features.

    All but the two class sizes comes from the model's scores, which SQL can't tell.
    """
    flows, feats = clean_flows(spark, sf)
    model = L.fit_tabular(flows, feats, L.gbt(5))
    other = V.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("duration"),
        F.lit("tcp").alias("protocol"), F.when(F.col("o_orderstatus") == "F", "attack")
        .otherwise("benign").alias("label"))
    cand, _ = FL.load_tabular(other)
    aligned = FL.align_features(cand.withColumnRenamed("y", "label"), feats, ["row_id", "label"])
    scored = written_table(L.score(model, aligned).select("label", "prob"), "scores")
    got = E.confusion(scored).crossJoin(E.auc(E.score_points(scored)))
    return got.select((F.col("tp") + F.col("fn")).alias("positives"), (F.col("fp") + F.col("tn")).alias("negatives"),
                      *got.columns)


@query("ml_load_tabular", f"""WITH {V.FLOW} SELECT row_id, CASE lower(trim(protocol)) WHEN 'tcp' THEN 6.0
  WHEN 'udp' THEN 17.0 WHEN 'icmp' THEN 1.0 ELSE 0.0 END::DOUBLE AS protocol, duration, packets_count,
  CAST(fwd_packets_count AS DOUBLE) AS fwd_packets_count, total_bytes,
  CAST(lower(trim(label)) NOT IN ({Q.names(K.BENIGN_LABELS)}) AS INT) AS label FROM flow""")
def ml_load_tabular(spark, sf):
    df, feats = clean_flows(spark, sf)
    return df.select("row_id", *feats, "label")


_ZS = ", ".join(f"round(({f} - avg({f}) FILTER (WHERE y = 0) OVER ()) / "
                f"stddev_pop({f}) FILTER (WHERE y = 0) OVER (), 6) AS {f}" for f in FLOW_FEATS)


@query("ml_standardize", f"""WITH {V.FLOW}, fl AS (SELECT *, CAST(lower(trim(label)) NOT IN
    ({Q.names(K.BENIGN_LABELS)}) AS INT) AS y FROM flow) SELECT row_id, {_ZS} FROM fl""")
def ml_standardize(spark, sf):
    df, _ = clean_flows(spark, sf)
    scaler = L.fit_scaler(df.where(F.col("label") == 0), FLOW_FEATS)
    return L.apply_scaler(df, scaler).select(
        "row_id", *[F.round(f, 6).alias(f) for f in FLOW_FEATS])


def embedding_errors(spark, sf):
    """Reconstruction errors of embeddings; labels below five play the benign part."""
    dims = [f"x{i}" for i in range(64)]
    emb = V.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), (F.col("label") >= 5).cast("int").alias("label"),
        *[F.col("embedding")[i].cast("double").alias(d) for i, d in enumerate(dims)])
    benign = emb.where(F.col("label") == 0)
    train = SP.stratified_split(benign, 0.8)
    scaler = L.fit_scaler(train.where(F.col("split") == "train"), dims)
    pc = L.fit_components(L.apply_scaler(train.where(F.col("split") == "train"), scaler), dims)
    valid = L.reconstruction_error(
        L.apply_scaler(train.where(F.col("split") == "test"), scaler).drop("split"), dims, pc)
    threshold = L.error_threshold(valid)
    return L.reconstruction_error(L.apply_scaler(emb, scaler), dims, pc), threshold


@query("ml_recon_error", """SELECT vec_id AS row_id, CAST(label >= 5 AS INT) AS label, true AS non_negative
  FROM embeddings""")
def ml_recon_error(spark, sf):
    errors, _ = embedding_errors(spark, sf)
    return errors.select("row_id", "label", (F.col("mse") >= 0).alias("non_negative"))


@query("ml_ae_score", """SELECT CAST(label >= 5 AS INT) AS label, CAST(count(*) AS BIGINT) AS rows,
  true AS few_benign_flagged FROM embeddings GROUP BY 1""")
def ml_ae_score(spark, sf):
    errors, t = embedding_errors(spark, sf)
    return L.anomaly_scores(errors, t).groupBy("label").agg(
        F.count(F.lit(1)).alias("rows"),
        ((F.col("label") == 1) | (F.avg("ae_pred") < 0.1)).alias("few_benign_flagged"))


@query("ml_platt", f"""WITH {V.PRED}, r AS (SELECT component, label, row_number() OVER (PARTITION BY component
    ORDER BY row_id) AS rn, count(*) OVER (PARTITION BY component) AS n FROM pred)
  SELECT component, CAST(count(*) AS BIGINT) AS rows, true AS optimal FROM r WHERE rn <= n // 2 GROUP BY component""")
def ml_platt(spark, sf):
    """The fits meet the conditions of the optimum: both derivatives of the penalised loss vanish."""
    cal = written_table(SP.halves(V.predictions(spark, sf), keys=["component"]).where(
        F.col("half") == "calibration"), "calibration")
    fits = L.fit_platt_by(cal, "component", ["c0", "c1", "c2"])
    gap = L.sigmoid(F.col("coef") * F.col("prob") + F.col("intercept")) - F.col("label")
    rows = F.count(F.lit(1))
    return cal.join(F.broadcast(fits), "component").groupBy("component").agg(
        rows.alias("rows"), ((F.abs(F.sum(gap)) / rows < 1e-5)
                             & (F.abs(F.sum(gap * F.col("prob")) + F.max("coef")) / rows < 1e-5)).alias("optimal"))


A, B, IA, IB = 6.5, 3.25, -2.0, -4.5
CAL = f"""{V.PRED}, cal AS (SELECT row_id, component, label, attack_type,
  1 / (1 + exp(-({A} * prob + {IA}))) AS a, 1 / (1 + exp(-({B} * ln(1 + prob * 10) + {IB}))) AS b FROM pred)"""


def two_scores(spark, sf):
    """Two calibrated scores per row: one of the probability, one of a log error."""
    return V.predictions(spark, sf).select(
        "row_id", "component", "label", "attack_type", L.platt(F.col("prob"), A, IA).alias("a"),
        L.platt(F.log1p(F.col("prob") * 10), B, IB).alias("b"))


@query("ml_platt_apply", f"WITH {CAL} SELECT row_id, round(a, 9) AS a, round(b, 9) AS b FROM cal")
def ml_platt_apply(spark, sf):
    return two_scores(spark, sf).select("row_id", F.round("a", 9).alias("a"), F.round("b", 9).alias("b"))


@query("ml_fuse", f"""WITH {CAL} SELECT row_id, round(a, 9) AS single_a, round(b, 9) AS single_b,
  round((a + b) / 2, 9) AS mean, round(greatest(a, b), 9) AS max, round(0.7 * a + 0.3 * b, 9) AS weighted
  FROM cal""")
def ml_fuse(spark, sf):
    cols = L.fuse(F.col("a"), F.col("b"))
    return two_scores(spark, sf).select(
        "row_id", *[F.round(c, 9).alias(n) for n, c in cols.items()])


FUSE_OR = f"""{CAL}, h AS (SELECT *, row_number() OVER (ORDER BY row_id) > count(*) OVER () // 2 AS late FROM cal),
  t AS (SELECT quantile_cont(a, 0.95) AS ta, quantile_cont(b, 0.95) AS tb FROM h WHERE label = 0 AND NOT late),
  s AS (SELECT label, UNNEST([ROW('or_half', a >= 0.5 OR b >= 0.5), ROW('or_calibrated', a >= ta OR b >= tb),
    ROW('mean', (a + b) / 2 >= 0.5), ROW('a', a >= 0.5), ROW('b', b >= 0.5)]) AS st FROM h, t WHERE late),
  ss AS (SELECT label, st[1] AS strategy, st[2] AS pred FROM s)"""


@query("ml_fuse_or", f"WITH {FUSE_OR}, {Q.confusion_sql('ss', 'pred', 'strategy')} SELECT * FROM conf")
def ml_fuse_or(spark, sf):
    df = SP.halves(two_scores(spark, sf))
    cal = df.where((F.col("half") == "calibration"))
    ta = E.benign_quantile(cal, {"t": 0.95}, "a").first()["t"]
    tb = E.benign_quantile(cal, {"t": 0.95}, "b").first()["t"]
    a, b = F.col("a"), F.col("b")
    hit = lambda c: F.when(c, 1.0).otherwise(0.0)
    rows = L.strategies_long(df.where(F.col("half") == "evaluation"), {
        "or_half": hit((a >= 0.5) | (b >= 0.5)), "or_calibrated": hit((a >= ta) | (b >= tb)),
        "mean": hit((a + b) / 2 >= 0.5), "a": hit(a >= 0.5), "b": hit(b >= 0.5)}, ["label"])
    return E.confusion(rows, keys=["strategy"])


WEIGHTS = [0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95, 1.00]


@query("ml_weight_sweep", f"""WITH {CAL}, ws AS (SELECT w, label, w * a + (1 - w) * b AS prob FROM cal,
    (SELECT CAST(UNNEST([{', '.join(map(str, WEIGHTS))}]) AS DOUBLE) AS w)), {Q.points_cte('ws', 'w')},
  g AS (SELECT w, {Q.AUC} AS roc_auc FROM pts GROUP BY w),
  r AS (SELECT w, tp / pos AS recall, threshold, row_number() OVER (PARTITION BY w
    ORDER BY tp DESC, threshold DESC) AS rn FROM pts WHERE fp / neg <= 0.01)
  SELECT w, recall, threshold, roc_auc FROM r JOIN g USING (w) WHERE rn = 1""",
       rounded=("threshold", "roc_auc"))
def ml_weight_sweep(spark, sf):
    return L.weight_sweep(two_scores(spark, sf), "a", "b", WEIGHTS).select(
        "w", "recall", "threshold", "roc_auc")


@query("ml_fusion_artifact")
def ml_fusion_artifact(spark, sf):
    """Calibrators, weights and the threshold at 1 % FPR on the second half, as one row."""
    base = V.predictions(spark, sf).withColumn("log_error", F.log1p(F.col("prob") * 10))
    df = SP.halves(base)
    cal = df.where(F.col("half") == "calibration")
    ca, ia = L.fit_platt(cal, "prob")
    cb, ib = L.fit_platt(cal, "log_error")
    fused = 0.7 * L.platt(F.col("prob"), ca, ia) + 0.3 * L.platt(F.col("log_error"), cb, ib)
    ev = df.where(F.col("half") == "evaluation").withColumn("prob", fused)
    thr = E.threshold_at_fpr(E.score_points(ev), 0.01)
    return thr.select(
        F.lit(ca).alias("coef_a"), F.lit(ia).alias("intercept_a"), F.lit(cb).alias("coef_b"),
        F.lit(ib).alias("intercept_b"), F.lit(0.7).alias("weight_a"), F.lit(0.3).alias("weight_b"),
        "threshold")


@query("ml_seq_classifier", f"WITH {Q.LABELLED} {_COUNTS} FROM lab1 WHERE session > 5")
def ml_seq_classifier(spark, sf):
    from tracewell.operators.normalize import is_attack
    rows = token_table(spark, sf).select(
        "audit_id", "session", "tokens",
        F.when(is_attack(F.col("actor")), 1).otherwise(0).alias("label"))
    rows = written_table(rows, "token-rows")
    train, _ = L.with_weight(rows.where(F.col("session") <= 5))
    model = L.token_pipeline().fit(train)
    return outcome(model, rows.where(F.col("session") > 5), rows.where(F.col("session") <= 5))


@query("ml_text_classifier", """WITH c AS (SELECT toxic, count(*) AS n FROM documents JOIN labels USING (doc_id)
    GROUP BY toxic), t AS (SELECT toxic, n - floor(n * CAST(0.8 AS DOUBLE)) AS n FROM c)
  SELECT CAST(sum(n) FILTER (WHERE toxic = 1) AS BIGINT) AS positives,
    CAST(sum(n) FILTER (WHERE toxic = 0) AS BIGINT) AS negatives, true AS learned FROM t""")
def ml_text_classifier(spark, sf):
    docs = V.table(spark, sf, "documents").join(V.table(spark, sf, "labels"), "doc_id")
    rows = materialize(docs.select(
        F.col("doc_id").alias("row_id"), "text", F.col("toxic").alias("label")))
    split = SP.stratified_split(rows)
    train, _ = L.with_weight(split.where(F.col("split") == "train").drop("split"))
    model = L.text_pipeline().fit(train)
    return outcome(model, split.where(F.col("split") == "test"), split.where(F.col("split") == "train"))


@query("ml_mlp_packets", f"""WITH {V.FLOW}, fl AS (SELECT CAST(lower(trim(label)) NOT IN
    ({Q.names(K.BENIGN_LABELS)}) AS INT) AS y FROM flow),
  t AS (SELECT y, count(*) - floor(count(*) * CAST(0.8 AS DOUBLE)) AS n FROM fl GROUP BY y)
  SELECT CAST(sum(n) FILTER (WHERE y = 1) AS BIGINT) AS positives,
    CAST(sum(n) FILTER (WHERE y = 0) AS BIGINT) AS negatives FROM t""")
def ml_mlp_packets(spark, sf):
    """Trained on four fifths of each class, scored on the last fifth."""
    df, feats = clean_flows(spark, sf)
    rows = written_table(SP.stratified_split(written_table(df, "flows")), "split")
    train = rows.where(F.col("split") == "train").drop("split")
    scaler = L.fit_scaler(train, feats)
    scaled = L.assembler(feats).transform(L.apply_scaler(L.balance_copies(train), scaler))
    model = L.packet_mlp(feats, iters=120).fit(scaled)
    test = L.assembler(feats).transform(L.apply_scaler(rows.where(F.col("split") == "test"), scaler))
    return outcome(model, test, scaled).drop("learned")


@query("ml_source_probe")
def ml_source_probe(spark, sf):
    a = V.table(spark, sf, "orders").select(F.col("o_totalprice").alias("x"),
                                            (F.col("o_orderkey") % 7).cast("double").alias("y"))
    b = V.table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("x"),
                                              (F.col("l_orderkey") % 7).cast("double").alias("y"))
    both = a.withColumn("label", F.lit(0)).unionByName(b.withColumn("label", F.lit(1)))
    return spark.createDataFrame([(L.source_probe(both, ["x", "y"]),)], "accuracy double")
