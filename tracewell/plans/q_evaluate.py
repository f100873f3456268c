"""Queries of the evaluation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import constants as K
from tracewell.operators import evaluate as E
from tracewell.operators import rules as RU
from tracewell.plans import sqltext as Q
from tracewell.plans import views as V
from tracewell.plans.q_windows import (
    TOKENS,
    scored_table,
    scored_windows,
    token_table,
    with_category,
)
from tracewell.plans.registry import query

PTS = Q.PRED_POINTS


def preds(spark, sf):
    return V.predictions(spark, sf)


def points(spark, sf):
    return E.score_points(preds(spark, sf))


@query("op_confusion", f"WITH {V.PRED}, {Q.confusion_sql('pred')} SELECT * FROM conf")
def op_confusion(spark, sf):
    return E.confusion(preds(spark, sf))


@query("op_per_attack_recall", f"""WITH {V.PRED} SELECT attack_type, CAST(count(*) AS BIGINT) AS support,
  avg(CAST(prob >= 0.5 AS INT)) AS recall FROM pred WHERE label = 1 GROUP BY attack_type""")
def op_per_attack_recall(spark, sf):
    return E.per_attack_recall(preds(spark, sf))


@query("op_roc_points", f"WITH {PTS} SELECT threshold, fp / neg AS fpr, tp / pos AS tpr FROM pts")
def op_roc_points(spark, sf):
    return E.roc_points(points(spark, sf))


@query("op_roc_auc", f"WITH {PTS} SELECT round({Q.AUC}, 9) AS roc_auc FROM pts")
def op_roc_auc(spark, sf):
    return E.auc(points(spark, sf)).select(F.round("roc_auc", 9).alias("roc_auc"))


@query("op_pr_points", f"""WITH {PTS} SELECT threshold, tp / (tp + fp) AS precision,
  tp / pos AS recall FROM pts""")
def op_pr_points(spark, sf):
    return E.pr_points(points(spark, sf))


@query("op_pr_auc", f"WITH {PTS} SELECT round({Q.AP}, 9) AS pr_auc FROM pts")
def op_pr_auc(spark, sf):
    return E.auc(points(spark, sf)).select(F.round("pr_auc", 9).alias("pr_auc"))


@query("op_best_f1", f"""WITH {PTS} SELECT threshold, tp / (tp + fp) AS precision, tp / pos AS recall,
  2 * tp / (tp + fp + pos) AS f1 FROM pts ORDER BY f1 DESC, threshold LIMIT 1""")
def op_best_f1(spark, sf):
    return E.best_f1(points(spark, sf))


def _recall_at(t):
    return f"""(SELECT {t}::DOUBLE AS target_fpr, fp / neg AS achieved_fpr, tp / pos AS recall, threshold
      FROM pts WHERE fp / neg <= {t} ORDER BY tp DESC, threshold DESC LIMIT 1)"""


@query("op_recall_at_fpr", f"WITH {PTS} {_recall_at(0.01)} UNION ALL {_recall_at(0.05)}")
def op_recall_at_fpr(spark, sf):
    p = points(spark, sf)
    return E.recall_at_fpr(p, 0.01).unionByName(E.recall_at_fpr(p, 0.05))


def _fpr_at(t):
    return f"""(SELECT {t}::DOUBLE AS target_recall, tp / pos AS achieved_recall, fp / neg AS fpr
      FROM pts WHERE tp / pos >= {t} ORDER BY fp / neg, threshold DESC LIMIT 1)"""


@query("op_fpr_at_recall", f"WITH {PTS} {_fpr_at(0.9)} UNION ALL {_fpr_at(0.95)}")
def op_fpr_at_recall(spark, sf):
    p = points(spark, sf)
    return E.fpr_at_recall(p, 0.9).unionByName(E.fpr_at_recall(p, 0.95))


@query("op_threshold_at_fpr", f"""WITH {V.PRED}, {Q.points_cte('pred', 'component')},
  r AS (SELECT component, max(threshold) AS t FROM (SELECT *, max(tp) OVER (PARTITION BY component) AS m
    FROM pts WHERE fp / neg <= 0.01) WHERE tp = m GROUP BY component),
  q AS (SELECT component, quantile_cont(prob, 0.99) AS benign_p99, quantile_cont(prob, 0.95) AS benign_p95
    FROM pred WHERE label = 0 GROUP BY component)
  SELECT q.component, coalesce(t, 0.5) AS threshold, benign_p99, benign_p95
  FROM q LEFT JOIN r ON q.component = r.component""",
       rounded=("benign_p99", "benign_p95"))
def op_threshold_at_fpr(spark, sf):
    df = preds(spark, sf)
    roc = E.threshold_at_fpr(E.score_points(df, keys=["component"]), 0.01, ["component"])
    ben = E.benign_quantile(df, {"benign_p99": 0.99, "benign_p95": 0.95}, keys=["component"])
    return roc.join(ben, "component")


STEPS = [round(0.05 * i, 2) for i in range(1, 20)]
SWEEP = f"""{V.PRED}, th AS (SELECT CAST(t AS DOUBLE) AS threshold FROM UNNEST([{', '.join(map(str, STEPS))}]) AS u(t)),
  px AS (SELECT threshold, prob, label FROM pred, th), {Q.confusion_sql('px', 'prob >= threshold', 'threshold')},
  sw AS (SELECT *, (recall + CASE WHEN tn + fp = 0 THEN 0 ELSE tn / (tn + fp) END) / 2
    AS balanced_accuracy FROM conf)"""


@query("op_threshold_sweep", f"WITH {SWEEP} SELECT * FROM sw")
def op_threshold_sweep(spark, sf):
    return E.threshold_sweep(preds(spark, sf), STEPS)


def _point(name, by, cond="TRUE"):
    return f"""(SELECT '{name}' AS point, threshold, f1, balanced_accuracy, precision, recall FROM sw
      WHERE {cond} ORDER BY {by} DESC, threshold LIMIT 1)"""


@query("op_operating_points", f"WITH {SWEEP} " + " UNION ALL ".join([
    _point("best_f1", "f1"), _point("best_balanced_accuracy", "balanced_accuracy"),
    _point("max_precision_recall_95", "precision", "recall >= 0.95"),
    _point("max_precision_recall_99", "precision", "recall >= 0.99")]))
def op_operating_points(spark, sf):
    return E.operating_points(E.threshold_sweep(preds(spark, sf), STEPS))


GROUPS = ["escv_eval", "lateral_eval", "peirates_eval", "stratus_eval", "lateralext_eval",
          "persistence_eval", "recon_eval"]
BENIGN = "part = 'test' AND label = 0"
GROUP_SQL = f"""{Q.LABELLED}, ben AS (SELECT prob FROM lab1 WHERE {BENIGN}),
  th AS (SELECT quantile_cont(prob, 0.99) AS t1, quantile_cont(prob, 0.95) AS t5 FROM ben),
  gr AS (SELECT part AS grp, prob, 1 AS label FROM lab1 WHERE part IN ({Q.names(GROUPS)}) AND label = 1
    UNION ALL SELECT g.grp, prob, 0 FROM ben, (SELECT DISTINCT part AS grp FROM lab1
      WHERE part IN ({Q.names(GROUPS)}) AND label = 1) g),
  {Q.points_cte('gr', 'grp')},
  a AS (SELECT grp, {Q.AUC} AS roc_auc, {Q.AP} AS pr_auc FROM pts GROUP BY grp),
  c AS (SELECT grp, CAST(count(*) FILTER (WHERE label = 1) AS BIGINT) AS n,
    count(*) FILTER (WHERE label = 1 AND prob >= t1) AS tp1, count(*) FILTER (WHERE label = 0 AND prob >= t1) AS fp1,
    count(*) FILTER (WHERE label = 1 AND prob >= t5) AS tp5, count(*) FILTER (WHERE label = 0 AND prob >= t5) AS fp5
    FROM gr, th GROUP BY grp)"""


@query("op_group_metrics", f"""WITH {GROUP_SQL} SELECT grp, n, round(roc_auc, 9) AS roc_auc,
  round(pr_auc, 9) AS pr_auc, tp1 / n AS recall_fpr1,
  CASE WHEN tp1 + fp1 = 0 THEN 0 ELSE tp1 / (tp1 + fp1) END AS precision_fpr1, tp5 / n AS recall_fpr5,
  CASE WHEN tp5 + fp5 = 0 THEN 0 ELSE tp5 / (tp5 + fp5) END AS precision_fpr5
  FROM c JOIN a USING (grp)""")
def op_group_metrics(spark, sf):
    df = scored_table(spark, sf)
    benign = df.where((F.col("part") == "test") & (F.col("label") == 0))
    attacks = df.where(F.col("part").isin(GROUPS) & (F.col("label") == 1)).withColumnRenamed(
        "part", "grp")
    t = E.benign_quantile(benign, {"t1": 0.99, "t5": 0.95}).first()
    present = [r[0] for r in attacks.select("grp").distinct().collect()]
    out = E.group_metrics(attacks, benign, "grp", present, F.lit(t["t1"]), F.lit(t["t5"]))
    return out.withColumns({"roc_auc": F.round("roc_auc", 9), "pr_auc": F.round("pr_auc", 9)})


@query("op_brier", f"""WITH {V.PRED} SELECT avg((prob - label) * (prob - label)) AS brier,
  CAST(count(*) AS BIGINT) AS rows FROM pred""",
       rounded=("brier",))
def op_brier(spark, sf):
    return E.brier(preds(spark, sf))


BINS = f"""{V.PRED}, b AS (SELECT CAST(least(floor(prob * 10), 9) AS BIGINT) AS bin,
    CAST(count(*) AS BIGINT) AS rows, avg(prob) AS mean_prob, avg(label) AS rate FROM pred GROUP BY 1)"""


@query("op_ece", f"WITH {BINS} SELECT round(sum(abs(mean_prob - rate) * rows) / sum(rows), 9) AS ece FROM b")
def op_ece(spark, sf):
    return E.ece(preds(spark, sf)).select(F.round("ece", 9).alias("ece"))


@query("op_calibration_bins", f"WITH {BINS} SELECT * FROM b",
       rounded=("mean_prob", "rate"))
def op_calibration_bins(spark, sf):
    return E.calibration_bins(preds(spark, sf))


_TACTIC = " ".join(f"WHEN part = '{p}' THEN '{t}'" for p, t in K.TACTIC_OF_PART.items())


@query("op_run_detection", f"""WITH {Q.LABELLED}, t AS (SELECT *, CASE WHEN {BENIGN} THEN 'BENIGN'
    WHEN label = 1 THEN CASE {_TACTIC} END END AS tactic FROM lab1),
  th AS (SELECT quantile_cont(prob, 0.95) AS t FROM t WHERE tactic = 'BENIGN'),
  r AS (SELECT tactic, session, uid, count(*) FILTER (WHERE prob >= t) >= 2 AS hit FROM t, th
    WHERE tactic IS NOT NULL GROUP BY 1, 2, 3),
  g AS (SELECT tactic, CAST(count(*) AS BIGINT) AS runs, CAST(count(*) FILTER (WHERE hit) AS BIGINT) AS caught
    FROM r GROUP BY tactic),
  tot AS (SELECT CAST(count(*) FILTER (WHERE tactic <> 'BENIGN') AS BIGINT) AS runs,
    CAST(count(*) FILTER (WHERE tactic <> 'BENIGN' AND hit) AS BIGINT) AS caught,
    count(*) FILTER (WHERE tactic = 'BENIGN' AND hit) AS fp FROM r)
  SELECT tactic, runs, caught, CAST(NULL AS DOUBLE) AS precision, caught / runs AS rate FROM g
  UNION ALL SELECT 'TOTAL', runs, caught, CASE WHEN caught + fp = 0 THEN 0 ELSE caught / (caught + fp) END,
    caught / runs FROM tot""")
def op_run_detection(spark, sf):
    from tracewell.operators.normalize import lookup
    df = scored_table(spark, sf)
    benign = (F.col("part") == "test") & (F.col("label") == 0)
    tactic = F.when(benign, "BENIGN").when(
        F.col("label") == 1, lookup(K.TACTIC_OF_PART, F.col("part")))
    df = df.withColumn("tactic", tactic).where(F.col("tactic").isNotNull())
    t = E.benign_quantile(df.where(F.col("tactic") == "BENIGN"), {"t": 0.95}).first()["t"]
    return E.run_detection(df, F.lit(t))


@query("op_heldout_recall", f"""WITH {Q.LABELLED} SELECT tool, CAST(count(*) AS BIGINT) AS windows,
  avg(CAST(prob >= 0.3 AS INT)) AS flagged, avg(n_events) AS mean_n_events,
  avg(severity) AS mean_severity FROM lab1 WHERE tool IN ('stratus', 'peirates', 'lowslow') GROUP BY tool""")
def op_heldout_recall(spark, sf):
    df = scored_windows(spark, sf).where(F.col("tool").isin("stratus", "peirates", "lowslow"))
    return E.heldout_recall(df, 0.3, ["n_events", "severity"])


MERGED = {"HELD": [v for k, v in K.PART_CATEGORY.items() if k != "compromised_eval"],
          "BENIGN": ["BENIGN can-i", "BENIGN normal"]}


@query("op_bucket_rates", f"""WITH {Q.LABELLED}, c AS (SELECT prob, {Q.CATEGORY} AS bucket FROM lab1),
  u AS (SELECT bucket, prob FROM c WHERE bucket IS NOT NULL """ + " ".join(
    f"UNION ALL SELECT '{n}', prob FROM c WHERE bucket IN ({Q.names(m)})" for n, m in MERGED.items())
       + """), r AS (SELECT bucket, CAST(count(*) FILTER (WHERE prob >= 0.3) AS BIGINT) AS fired,
    CAST(count(*) AS BIGINT) AS total FROM u GROUP BY bucket)
  SELECT *, fired / total AS rate FROM r""")
def op_bucket_rates(spark, sf):
    df = with_category(scored_windows(spark, sf)).where(F.col("category").isNotNull())
    return E.bucket_rates(df, "category", MERGED, 0.3)


MODELS = f"""{V.PRED}, mp AS (SELECT component AS model, prob, label, attack_type FROM pred)"""


def by_model(spark, sf):
    return preds(spark, sf).withColumnRenamed("component", "model")


@query("op_model_compare", f"""WITH {MODELS}, {Q.confusion_sql('mp', key='model')}, {Q.points_cte('mp', 'model')},
  a AS (SELECT model, round({Q.AUC}, 9) AS roc_auc FROM pts GROUP BY model)
  SELECT model, accuracy, precision, recall, f1, roc_auc FROM conf JOIN a USING (model)""")
def op_model_compare(spark, sf):
    return E.model_compare(by_model(spark, sf)).withColumn("roc_auc", F.round("roc_auc", 9))


@query("op_pivot_recall", f"""WITH {MODELS} SELECT attack_type, """ + ", ".join(
    f"avg(CAST(prob >= 0.5 AS INT)) FILTER (WHERE model = '{m}') AS {m}" for m in ("c0", "c1", "c2"))
       + " FROM mp WHERE label = 1 GROUP BY attack_type")
def op_pivot_recall(spark, sf):
    return E.pivot_recall(by_model(spark, sf), ["c0", "c1", "c2"])


SCENARIO = """CASE attack_type WHEN 'discovery' THEN 'recon' WHEN 'container_exec' THEN 'exec_abuse'
 WHEN 'privilege_escalation' THEN 'rbac_escalation' WHEN 'credential_theft' THEN 'secret_access'
 WHEN 'token_theft' THEN 'sa_token_abuse' ELSE 'other' END"""


@query("op_mitre_coverage", f"""WITH {V.PRED}, s AS (SELECT {SCENARIO} AS scenario, CAST(count(*) AS BIGINT)
    AS support, avg(CAST(prob >= 0.5 AS INT)) AS recall FROM pred WHERE label = 1 GROUP BY 1),
  c AS (SELECT * FROM (VALUES """ + ", ".join(str(t) for t in K.TECHNIQUES) + """)
    AS v(scenario, technique, name, tactic))
  SELECT c.scenario, technique, name, tactic, recall, coalesce(support, 0) AS support,
    coalesce(recall > 0, FALSE) AS covered FROM c LEFT JOIN s ON c.scenario = s.scenario""")
def op_mitre_coverage(spark, sf):
    df = preds(spark, sf).withColumn("attack_type", F.expr(SCENARIO))
    return E.technique_coverage(df)


@query("op_keyword_agreement", f"""WITH {TOKENS}, a AS (SELECT list_has_any(tokens,
    [{Q.names(K.SIGNATURE_TOKENS)}]) AS x, is_imp = 1 AS y FROM tk)
  SELECT avg(CAST(x = y AS INT)) AS agreement, CAST(count(*) AS BIGINT) AS rows FROM a""")
def op_keyword_agreement(spark, sf):
    df = token_table(spark, sf).withColumns(
        {"x": RU.keyword_rule(), "y": F.col("is_imp") == 1})
    return E.agreement(df, "x", "y")


@query("op_density_split", f"""WITH {TOKENS}, a AS (SELECT list_has_any(tokens,
    [{Q.names(K.DISTINCT_TOKENS)}]) AS distinctive, value / (value + 50) AS prob FROM tk)
  SELECT distinctive, CAST(count(*) AS BIGINT) AS windows, min(prob) AS min_prob, avg(prob) AS mean_prob,
    max(prob) AS max_prob, avg(CAST(prob >= 0.5 AS INT)) AS detected FROM a GROUP BY distinctive""",
       rounded=("mean_prob",))
def op_density_split(spark, sf):
    df = token_table(spark, sf).withColumn("prob", F.col("value") / (F.col("value") + 50))
    return E.density_split(df)
