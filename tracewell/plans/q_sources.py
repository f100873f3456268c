"""Queries of the sources and sinks."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tracewell import schemas
from tracewell.functions import constants as K
from tracewell.operators import evaluate as E
from tracewell.operators import windows as W
from tracewell.operators.normalize import is_attack, tool_label
from tracewell.plans import sqltext as Q
from tracewell.plans import views as V
from tracewell.plans.registry import query
from tracewell.session import scratch_path
from tracewell.sources import logstore as L
from tracewell.sources import readers as R
from tracewell.sources import writers as S

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


@query("src_audit_jsonl", f"""WITH {V.LINES}
  SELECT CAST(copy AS INT) AS copy, audit_id AS seq, CAST(broken AS INT) AS bad,
    CASE WHEN broken THEN '' ELSE actor END AS user_name,
    CASE WHEN broken THEN '' ELSE verb END AS verb,
    CASE WHEN broken THEN -1 ELSE code END AS code FROM lines WHERE NOT blank""")
def src_audit_jsonl(spark, sf):
    df = R.parse_json_lines(V.audit_lines(spark, sf), "log_s", schemas.AUDIT_EVENT)
    return df.select("copy", "seq", F.col("_bad").cast("int").alias("bad"),
                     F.coalesce("event.user.username", F.lit("")).alias("user_name"),
                     F.coalesce("event.verb", F.lit("")).alias("verb"),
                     F.coalesce("event.responseStatus.code", F.lit(-1)).alias("code"))


def _lit(ts: str):
    return F.lit(ts).cast("timestamp")


STORED = "seq bigint, copy int, us bigint, time_generated timestamp, category string, log_s string"


def log_store(spark, sf):
    """The derived log rows as a log store."""
    path = scratch_path(spark, "log-store")
    L.write_log_store(V.audit_lines(spark, sf), path)
    return path


@query("src_log_table", f"""WITH {V.LINES} SELECT audit_id AS seq, CAST(copy AS INT) AS copy, us
  FROM lines WHERE category IN ('kube-audit', 'kube-audit-admin')
  AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'""")
def src_log_table(spark, sf):
    return L.read_log_store(
        spark, log_store(spark, sf), STORED, datetime(2024, 1, 5), datetime(2024, 1, 20),
        K.LOG_CATEGORIES).select("seq", "copy", "us")


@query("src_log_lookback", f"""WITH {V.LINES} SELECT audit_id AS seq, CAST(copy AS INT) AS copy
  FROM lines WHERE ts > TIMESTAMP '2024-01-20' - INTERVAL 600 MINUTE""")
def src_log_lookback(spark, sf):
    return R.log_lookback(V.audit_lines(spark, sf), 600, _lit("2024-01-20")).select("seq", "copy")


@query("src_log_padded_range", f"""WITH {V.LINES} SELECT audit_id AS seq, CAST(copy AS INT) AS copy
  FROM lines WHERE ts BETWEEN TIMESTAMP '2024-01-08' - INTERVAL 2 MINUTE
  AND TIMESTAMP '2024-01-09' + INTERVAL 6 MINUTE""")
def src_log_padded_range(spark, sf):
    return L.read_padded_range(spark, log_store(spark, sf), datetime(2024, 1, 8), datetime(2024, 1, 9),
                               STORED).select("seq", "copy")


@query("src_log_payload_filter", f"""WITH {V.LINES} SELECT audit_id AS seq, CAST(copy AS INT) AS copy,
  actor AS user_name FROM lines WHERE NOT broken AND NOT blank
  AND (actor = 'ci-deployer' OR contains(actor, 'stratus'))""")
def src_log_payload_filter(spark, sf):
    df = R.log_payload_filter(V.audit_lines(spark, sf), ["ci-deployer"], ["stratus"])
    return df.select("seq", "copy", F.get_json_object("log_s", "$.user.username").alias("user_name"))


def marker_lines(spark, sf):
    """One line per event: starts, ends and notes of a session per user."""
    kind = (F.when(F.col("event_type") == "signup", "START")
            .when(F.col("event_type").isin("purchase", "error"), "END").otherwise("NOTE"))
    stamp = F.date_format("ts", ISO)
    return V.events(spark, sf).select(
        F.col("event_id").alias("pos"),
        F.concat_ws(" ", F.lit("SESSION"), F.col("user_id").cast("string"), kind, stamp).alias(
            "value"))


@query("src_sessions", """WITH m AS (SELECT event_id AS pos, CAST(user_id AS INT) AS session, ts,
    CASE WHEN event_type = 'signup' THEN 'START'
    WHEN event_type IN ('purchase', 'error') THEN 'END' ELSE 'NOTE' END AS kind FROM events),
  s AS (SELECT *, last_value(CASE WHEN kind = 'START' THEN ts END IGNORE NULLS)
      OVER (PARTITION BY session ORDER BY pos) AS start,
    count(*) FILTER (WHERE kind = 'START') OVER (PARTITION BY session ORDER BY pos) AS run FROM m),
  e AS (SELECT *, first_value(CASE WHEN kind = 'END' THEN ts END IGNORE NULLS)
      OVER (PARTITION BY session, run ORDER BY pos) AS fin FROM s)
  SELECT session, pos, epoch_us(start) AS start_us, epoch_us(fin) AS end_us FROM e
  WHERE kind = 'END' AND start IS NOT NULL""")
def src_sessions(spark, sf):
    return R.parse_sessions(marker_lines(spark, sf)).select(
        "session", "pos", F.unix_micros("start").alias("start_us"),
        F.unix_micros("end").alias("end_us"))


@query("src_marker_kv", """SELECT concat('K', CAST(event_id AS VARCHAR)) AS key, epoch_us(ts) AS us
  FROM events WHERE event_type = 'purchase'""")
def src_marker_kv(spark, sf):
    ev = V.events(spark, sf)
    line = F.when(F.col("event_type") == "purchase", F.concat(
        F.lit("K"), F.col("event_id").cast("string"), F.lit("="), F.date_format("ts", ISO))
    ).otherwise(F.concat(F.lit("# "), "event_type"))
    return R.parse_markers(ev.select(line.alias("value"))).select(
        "key", F.unix_micros("ts").alias("us"))


@query("src_attack_windows", f"""WITH {V.PRED} SELECT row_id AS pos,
  CASE WHEN k % 7 = 0 THEN 'attack' ELSE attack_type END AS attack_type,
  us AS start_us, us + 60000000 AS end_us FROM pred""")
def src_attack_windows(spark, sf):
    p = V.predictions(spark, sf).withColumn("later", F.col("ts") + F.expr("INTERVAL 60 SECONDS"))
    line = F.to_json(F.struct(
        F.when(F.col("k") % 7 != 0, F.col("attack_type")).alias("attack_type"),
        F.date_format("ts", ISO).alias("start"), F.date_format("later", ISO).alias("end")))
    df = R.parse_attack_windows(p.select(F.col("row_id").alias("pos"), line.alias("value")))
    return df.select("pos", "attack_type", F.unix_micros("start").alias("start_us"),
                     F.unix_micros("end").alias("end_us"))


@query("src_csv_chunked", f"""WITH {V.FLOW} SELECT row_id, src_ip, packets_count, label FROM flow""")
def src_csv_chunked(spark, sf):
    df = V.flows(spark, sf).select("row_id", "src_ip", "packets_count", "label")
    text = df.select([F.col(c).cast("string") for c in df.columns])
    repeated = spark.createDataFrame([tuple(df.columns)] * 3, text.schema)
    path = scratch_path(spark, "csv")
    text.unionByName(repeated).write.option("header", True).option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    back = R.read_csv_clean(spark, path)
    return back.select(F.col("row_id").cast("bigint"), "src_ip",
                       F.col("packets_count").cast("double"), "label")


@query("src_csv_union", f"""WITH {V.FLOW} SELECT row_id, src_ip, CAST(NULL AS DOUBLE) AS duration,
  true AS has_file FROM flow UNION ALL SELECT row_id, NULL, duration, true FROM flow""")
def src_csv_union(spark, sf):
    df = V.flows(spark, sf)
    a, b = scratch_path(spark, "a"), scratch_path(spark, "b")
    df.select("row_id", "src_ip").write.option("header", True).csv(a)
    df.select("row_id", "duration").write.option("header", True).csv(b)
    out = R.read_csv_union(spark, [a, b])
    return out.select(F.col("row_id").cast("bigint"), "src_ip", F.col("duration").cast("double"),
                      F.col("source_file").endswith(".csv").alias("has_file"))


@query("src_predictions", f"""WITH {V.PRED} SELECT component AS model, CAST(count(*) AS BIGINT) AS rows,
  sum(label)::BIGINT AS attacks FROM pred GROUP BY component""")
def src_predictions(spark, sf):
    root = scratch_path(spark, "models")
    df = V.predictions(spark, sf).select("component", "row_id", "label", "prob")
    for model in ("c0", "c1", "c2"):
        df.where(F.col("component") == model).drop("component").write.option("header", True).csv(
            f"{root}/{model}/predictions")
    return R.read_predictions(spark, root).groupBy("model").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("label").cast("bigint")).alias("attacks"))


@query("src_tokens_jsonl", f"""WITH {V.AUDIT} SELECT audit_id, actor AS user_name,
  concat(verb, ':', resource, ':', sub) AS last_token, CAST(20 AS BIGINT) AS n_tokens FROM audit""")
def src_tokens_jsonl(spark, sf):
    path = scratch_path(spark, "tokens")
    tok = W.token_windows(V.audit(spark, sf))
    S.write_tokens(tok.select(F.col("audit_id").cast("string").alias("timestamp"),
                              F.col("actor").alias("user"), "tokens"), path)
    back = R.read_tokens(spark, path)
    return back.select(F.col("timestamp").cast("bigint").alias("audit_id"),
                       F.col("user").alias("user_name"),
                       F.element_at("tokens", -1).alias("last_token"),
                       F.size("tokens").cast("bigint").alias("n_tokens"))


RULE_TEXT = """CASE k % 6 WHEN 0 THEN 'Terminal shell in container' WHEN 1 THEN
 'Read sensitive file untrusted' WHEN 2 THEN 'Launch Privileged Container' WHEN 3 THEN
 'Contact K8S API Server From Container' WHEN 4 THEN 'Sensitive mount by ssh' ELSE 'Other rule' END"""
PRIORITY = """CASE k % 10 WHEN 0 THEN 'Emergency' WHEN 1 THEN 'Alert' WHEN 2 THEN 'Critical'
 WHEN 3 THEN 'Error' WHEN 4 THEN 'Warning' WHEN 5 THEN 'Notice' WHEN 6 THEN 'Informational'
 WHEN 7 THEN 'Debug' ELSE 'Strange' END"""


def syscall_lines(spark, sf):
    """Syscall alerts as JSON lines, with text lines, broken JSON and rows without a rule."""
    ev = V.events(spark, sf).selectExpr(
        "event_id AS seq", "k", "ts", f"{RULE_TEXT} AS rule", f"{PRIORITY} AS priority",
        "CASE WHEN k % 4 = 0 THEN '' ELSE concat('pod-', CAST(user_id % 12 AS STRING)) END AS pod")
    stamp = F.when(F.col("k") % 25 != 7, F.date_format("ts", ISO))
    obj = F.to_json(F.struct(
        stamp.alias("time"), F.when(F.col("k") % 21 != 5, F.col("rule")).alias("rule"), "priority",
        F.lit("output text").alias("output"),
        F.create_map(F.lit("k8s.pod.name"), "pod").alias("output_fields")))
    line = F.when(F.col("k") % 27 == 3, F.lit("started engine")).when(
        F.col("k") % 28 == 4, F.lit('{"rule": ')).otherwise(obj)
    return ev.select("seq", "k", line.alias("value"))


SYSCALL = f"""sysc AS (SELECT event_id AS seq, k, us, {RULE_TEXT} AS rule, {PRIORITY} AS priority,
  CASE WHEN k % 4 = 0 THEN '' ELSE concat('pod-', CAST(user_id % 12 AS VARCHAR)) END AS pod,
  k % 25 <> 7 AS has_time FROM ev WHERE k % 27 <> 3 AND k % 28 <> 4 AND k % 21 <> 5)"""


@query("src_syscall_json", f"WITH {V.EV}, {SYSCALL} SELECT seq, rule, priority, pod FROM sysc")
def src_syscall_json(spark, sf):
    return R.parse_syscall_lines(syscall_lines(spark, sf)).select(
        "seq", "rule", "priority",
        F.try_element_at("output_fields", F.lit("k8s.pod.name")).alias("pod"))


def labelled_features(spark, sf):
    f = W.window_features(V.audit(spark, sf)).withColumn("user", F.col("actor"))
    tool = tool_label(F.col("user"))
    return f.withColumn("tool", tool).withColumn(
        "label", F.when(is_attack(F.col("user"), F.col("tool")), 1).otherwise(0))


@query("sink_feature_csv", f"""WITH {Q.LABELLED} SELECT label, {', '.join(K.ALL_FEATURES)},
  actor AS "user", tool, session FROM lab1""")
def sink_feature_csv(spark, sf):
    path = scratch_path(spark, "features")
    S.write_features(labelled_features(spark, sf), path)
    return spark.read.parquet(path)


@query("sink_split_tables", f"""WITH {V.FLOW} SELECT CASE WHEN source_file <= 'day4.csv' THEN 'train'
  ELSE 'test' END AS split, CAST(label <> 'Benign ' AS INT) AS label,
  CAST(count(*) AS BIGINT) AS rows FROM flow GROUP BY 1, 2""")
def sink_split_tables(spark, sf):
    from tracewell.operators import flow, splits
    df = splits.holdout_file(V.flows(spark, sf))
    df = df.withColumn("label", flow.label_binary(df, "label")).drop("l_shipdate")
    path = scratch_path(spark, "splits")
    S.write_splits(df, path)
    return spark.read.schema("split string, label int, rows bigint").json(f"{path}/summary")


@query("sink_predictions", f"WITH {V.PRED} SELECT row_id, prob, label, component FROM pred")
def sink_predictions(spark, sf):
    path = scratch_path(spark, "pred")
    S.write_predictions(V.predictions(spark, sf).select("row_id", "prob", "label", "component"), path)
    return spark.read.parquet(f"{path}/predictions")


@query("sink_curves", f"""WITH {Q.PRED_POINTS} SELECT 'roc' AS curve, threshold,
    fp / neg AS x, tp / pos AS y FROM pts
  UNION ALL SELECT 'pr', threshold, tp / pos, tp / (tp + fp) FROM pts""")
def sink_curves(spark, sf):
    path = scratch_path(spark, "curves")
    pts = E.score_points(V.predictions(spark, sf))
    S.write_curves(E.roc_points(pts), E.pr_points(pts), path)
    roc = spark.read.parquet(f"{path}/roc").select(
        F.lit("roc").alias("curve"), "threshold", F.col("fpr").alias("x"), F.col("tpr").alias("y"))
    pr = spark.read.parquet(f"{path}/pr").select(
        F.lit("pr").alias("curve"), "threshold", F.col("recall").alias("x"),
        F.col("precision").alias("y"))
    return roc.unionByName(pr)
