"""Queries of the streaming jobs: each drains its input and returns the table it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell import schemas
from tracewell.functions import constants as K
from tracewell.operators import correlate as C
from tracewell.operators import normalize as N
from tracewell.operators.windows import window_features
from tracewell.plans import sqltext as Q
from tracewell.plans import views as V
from tracewell.plans.q_correlate import ALERTS, INC, METRICS, metrics
from tracewell.plans.q_sources import STORED, log_store
from tracewell.plans.q_windows import TOKENS
from tracewell.plans.registry import query
from tracewell.session import scratch_path
from tracewell.sources.logstore import stream_log_store
from tracewell.sources.readers import parse_json_lines, stream_json
from tracewell.sources.writers import write_alert_stream
from tracewell.streaming import jobs as S
from tracewell.streaming import rules as R
from tracewell.streaming import state as ST


def event_stream(spark, sf):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return (S.stream_table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
            .withColumn("us", F.unix_micros("ts")).withColumn("k", F.expr(V.K_INT)))


def audit_stream(spark, sf):
    return V.audit_from(event_stream(spark, sf))


def landing(spark, sf):
    """The derived log rows as JSON files in a landing folder."""
    path = scratch_path(spark, "landing")
    V.audit_lines(spark, sf).select(
        "seq", "us", "k", F.date_format("time_generated", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias(
            "time_generated"), "category", "log_s").write.json(path)
    return path


LANDED = "seq bigint, us bigint, k int, time_generated timestamp, category string, log_s string"


def landed_events(spark, sf):
    from pyspark.sql.types import StructType
    schema = StructType.fromDDL(LANDED)
    lines = stream_json(spark, landing(spark, sf), schema)
    return parse_json_lines(lines, "log_s", schemas.AUDIT_EVENT).where(~F.col("_bad"))


def drain(spark, stream, name):
    return S.run_to_table(stream, scratch_path(spark, name), scratch_path(spark, f"{name}-cp"))


@query("str_file_source", f"""WITH {V.LINES} SELECT audit_id AS seq, verb, actor FROM lines
  WHERE NOT broken AND NOT blank""")
def str_file_source(spark, sf):
    ev = N.flatten_event(landed_events(spark, sf))
    return drain(spark, ev.select("seq", "verb", "actor"), "tail")


@query("str_dedup", f"""WITH {V.LINES} SELECT audit_id AS seq, json_id AS audit_key FROM lines
    WHERE NOT broken AND NOT blank AND json_id = '' UNION ALL
  SELECT DISTINCT audit_id, json_id FROM lines WHERE NOT broken AND NOT blank AND json_id <> ''""")
def str_dedup(spark, sf):
    ev = N.flatten_event(landed_events(spark, sf)).withColumnRenamed("time_generated", "ts")
    return drain(spark, S.dedup(ev.select("seq", "ts", "audit_key")).select("seq", "audit_key"),
                 "dedup")


@query("str_poll_source", f"""WITH {V.LINES}, r AS (SELECT * FROM lines WHERE NOT broken AND NOT blank
    AND category <> 'other')
  SELECT audit_id AS seq, actor FROM r WHERE json_id = '' UNION ALL
  SELECT DISTINCT audit_id, actor FROM r WHERE json_id <> ''""")
def str_poll_source(spark, sf):
    rows = stream_log_store(spark, log_store(spark, sf), STORED, K.LOG_CATEGORIES, settle_seconds=0)
    lines = parse_json_lines(rows, "log_s", schemas.AUDIT_EVENT).where(~F.col("_bad"))
    ev = N.flatten_event(lines).withColumnRenamed("time_generated", "ts")
    out, state = scratch_path(spark, "poll"), scratch_path(spark, "poll-cp")

    def keep(df, batch_id):
        df.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    S.run_batches(S.dedup(ev.select("seq", "ts", "audit_key", "actor")), keep, state)
    return spark.read.parquet(out).select("seq", "actor")


def features(spark, sf, keep=("audit_id",)):
    """The stream of feature rows, with these columns of the events."""
    return ST.ActorHistory().features(audit_stream(spark, sf), list(keep))


@query("str_actor_history", f"WITH {Q.FEATURES} SELECT audit_id, {', '.join(K.ALL_FEATURES)} FROM feat")
def str_actor_history(spark, sf):
    return drain(spark, features(spark, sf).select("audit_id", *K.ALL_FEATURES), "history")


@query("str_cumulative", f"""WITH {Q.FEATURES} SELECT audit_id, cum_secrets, cum_rbac_w, cum_exec,
  cum_crb FROM feat""")
def str_cumulative(spark, sf):
    return drain(spark, features(spark, sf).select(
        "audit_id", "cum_secrets", "cum_rbac_w", "cum_exec", "cum_crb"), "totals")


@query("str_token_stream", f"""WITH {V.AUDIT}, tk AS (SELECT audit_id, list(concat(verb, ':', resource, ':', sub))
    OVER (PARTITION BY session, actor ORDER BY us, audit_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS l
    FROM audit WHERE NOT starts_with(actor, 'system:'))
  SELECT audit_id, array_to_string(list_concat(list_transform(range(20 - len(l)), lambda x: '<PAD>'), l), ' ')
    AS tokens FROM tk""")
def str_token_stream(spark, sf):
    rows = ST.ActorHistory().token_windows(S.tokens(audit_stream(spark, sf)), ["audit_id"])
    return drain(spark, rows.select("audit_id", F.array_join("tokens", " ").alias("tokens")), "tokens")


SCORED = f"{Q.FEATURES}, sc AS (SELECT *, CAST({Q.SCORE} AS DOUBLE) AS prob FROM feat)"


def with_prob(df):
    score = (F.col("severity") * 7 + F.col("n_forbid") * 3 + F.col("n_delete") * 5
             + F.col("k") % 10) / 130.0
    return df.withColumn("prob", score.cast("double"))


@query("str_episode_alert", f"""WITH {SCORED} SELECT session, actor,
  CAST(count(*) FILTER (WHERE prob >= 0.5) AS BIGINT) AS fired, max(prob) AS max_prob FROM sc
  GROUP BY session, actor HAVING count(*) FILTER (WHERE prob >= 0.5) >= 2""",
       rounded=("max_prob",))
def str_episode_alert(spark, sf):
    alerts = ST.episode_alerts(with_prob(features(
        spark, sf, ["session", "actor", "us", "audit_id", "verb", "resource", "k"])))
    return drain(spark, alerts.select("session", "actor", F.col("n_windows_fired").alias("fired"), "max_prob"), "alerts")


def live_events(spark, sf):
    return S.dedup(audit_stream(spark, sf).withColumn("audit_key", F.col("audit_id").cast("string")))


def live_alerts(spark, sf):
    return drain(spark, ST.live_alerts(live_events(spark, sf), with_prob), "live")


_REASONS = {"rule_f": "has_crb >= 1 OR has_exec >= 1 OR has_impersonation >= 1 OR (has_secret >= 1 AND secret_ns >= 2)",
            "rule_recon": "n_selfreview >= 5", "rule_destruct": "n_delete >= 5",
            "rule_hijack": "n_create_workload >= 1", "rule_persist": "has_csr >= 1 OR has_tokenreq >= 1"}
_REASONS["rule_anom"] = " OR ".join(f"({v})" for n, v in _REASONS.items() if n != "rule_f")
LIVE = f"""{SCORED}, la AS (SELECT session, actor, CAST(count(*) FILTER (WHERE prob >= 0.5) AS BIGINT) AS n_windows_fired,
    max(prob) AS max_prob, arg_max(verb, ROW(us, audit_id)) AS last_verb,
    arg_max(resource, ROW(us, audit_id)) AS last_resource,
    concat_ws(' ', {', '.join(f"CASE WHEN bool_or({c}) THEN '{n}' END" for n, c in _REASONS.items())}) AS reasons
    FROM sc GROUP BY session, actor HAVING count(*) FILTER (WHERE prob >= 0.5) >= 2),
  lb AS (SELECT *, CASE WHEN max_prob >= 0.95 THEN 'CRITICAL' WHEN max_prob >= 0.85 THEN 'HIGH'
    WHEN max_prob >= 0.70 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM la)"""


@query("str_live_alerts", f"WITH {LIVE} SELECT * FROM lb", rounded=("max_prob",))
def str_live_alerts(spark, sf):
    """Dedup, history, score, K-of-window alert and its record, in one streaming query."""
    return live_alerts(spark, sf).withColumn("reasons", F.array_join("reasons", " "))


@query("sink_live_counters", f"""WITH {LIVE} SELECT 'alerts_by_severity' AS metric, severity AS label,
    CAST(count(*) AS BIGINT) AS value FROM lb GROUP BY severity
  UNION ALL SELECT 'alerts_by_reason', r, CAST(count(*) AS BIGINT) FROM lb, UNNEST(string_split(reasons, ' ')) AS u(r)
    WHERE r <> '' GROUP BY r
  UNION ALL SELECT 'active_actors', '', CAST(count(DISTINCT actor) AS BIGINT) FROM audit""")
def sink_live_counters(spark, sf):
    """Alerts by severity and reason from the alerts' stream, and actors when they are first seen."""
    alerts = live_alerts(spark, sf)
    actors = drain(spark, ST.first_seen(live_events(spark, sf), "actor"), "actors")
    count = F.count(F.lit(1)).alias("value")
    by = lambda df, metric, label: df.groupBy(F.lit(metric).alias("metric"), label.alias("label")).agg(count)
    return (by(alerts, "alerts_by_severity", F.col("severity"))
            .unionByName(by(alerts.select(F.explode("reasons").alias("reason")), "alerts_by_reason", F.col("reason")))
            .unionByName(actors.agg(count).select(
                F.lit("active_actors").alias("metric"), F.lit("").alias("label"), "value")))


@query("str_score", f"WITH {V.AUDIT} SELECT audit_id, true AS as_in_batch FROM audit")
def str_score(spark, sf):
    """A model fitted on batch features scores the live feature rows; the batch scores them alike."""
    from tracewell.models import learners as L
    from tracewell.plans.q_models import FEATS, prepared, train_table
    model = L.fit_tabular(train_table(prepared(spark, sf)), FEATS, L.gbt(5))
    live = drain(spark, L.score(model, features(spark, sf).select("audit_id", *FEATS)).select("audit_id", "prob"), "scores")
    batch = L.score(model, window_features(V.audit(spark, sf)).select("audit_id", *FEATS)).select(
        "audit_id", F.col("prob").alias("again"))
    return live.join(batch, "audit_id").select("audit_id", (F.col("prob") == F.col("again")).alias("as_in_batch"))


@query("str_incident_session", f"""WITH {ALERTS}, lg AS (SELECT *, us - lag(us) OVER (PARTITION BY actor
    ORDER BY us, seq) AS step FROM al WHERE raw_score >= 0.3),
  gp AS (SELECT *, sum(CASE WHEN step IS NULL OR step > 3600000000 THEN 1 ELSE 0 END)
    OVER (PARTITION BY actor ORDER BY us, seq) AS grp FROM lg),
  i AS (SELECT actor, min(us) AS start_us, max(us) AS end_us, CAST(count(*) AS BIGINT) AS n_alerts,
    CAST(count(*) FILTER (WHERE hint <> '') AS BIGINT) AS n_hints, max(raw_score) AS base_score
    FROM gp GROUP BY actor, grp),
  w AS (SELECT max(us) // 1000 * 1000 - 900000000 AS wm FROM lg)
  SELECT i.* FROM i, w WHERE end_us + 3600000000 <= wm""")
def str_incident_session(spark, sf):
    alerts = C.alerts_from_predictions(V.predictions_from(event_stream(spark, sf)))
    alerts = alerts.withColumn("ts", F.timestamp_micros("us")).where(F.col("raw_score") >= 0.3)
    return drain(spark, S.incident_sessions(alerts, "1 hour"), "incidents")


@query("sink_counters", f"""WITH {V.PRED}, c AS (SELECT CASE WHEN prob >= 0.5 THEN 'attack' ELSE 'benign' END
    AS label, us // 60000000 * 60000000 AS win_us FROM pred),
  w AS (SELECT max(us) // 1000 * 1000 - 900000000 AS wm FROM pred)
  SELECT 'predictions_total' AS metric, label, win_us, CAST(count(*) AS BIGINT) AS value FROM c, w
  WHERE win_us + 60000000 <= wm GROUP BY label, win_us""")
def sink_counters(spark, sf):
    stream = V.predictions_from(event_stream(spark, sf)).withColumn(
        "verdict", F.when(F.col("prob") >= 0.5, "attack").otherwise("benign"))
    return drain(spark, S.counters(stream, "predictions_total", "verdict"), "counters")


@query("sink_alert_stream", f"""WITH {TOKENS} SELECT audit_id, actor, value / (value + 50) AS prob,
  CASE WHEN value / (value + 50) >= 0.95 THEN 'CRITICAL' WHEN value / (value + 50) >= 0.85 THEN 'HIGH'
    WHEN value / (value + 50) >= 0.70 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  array_to_string(tokens[-5:], ' ') AS last_tokens FROM tk
  WHERE value / (value + 50) >= 0.5""")
def sink_alert_stream(spark, sf):
    """Token windows are scored and turned into alert records inside the live query."""
    rows = ST.ActorHistory().token_windows(audit_stream(spark, sf), ["audit_id", "actor", "value"])
    scored = rows.withColumn("prob", F.col("value") / (F.col("value") + 50))
    alerts = S.alert_records(scored).withColumn("last_tokens", F.array_join("last_tokens", " "))
    path = scratch_path(spark, "alerts")
    write_alert_stream(alerts, path, scratch_path(spark, "alerts-cp"))
    return spark.read.schema(alerts.schema).json(path)


def sample_stream(spark, sf):
    """The counter samples as a stream."""
    path = scratch_path(spark, "samples")
    table = metrics(spark, sf)
    table.write.parquet(path)
    return spark.readStream.schema(table.schema).parquet(path).withColumn("ts", F.timestamp_micros("us"))


# Windows that the watermark has passed when the stream is drained.
PASSED = "SELECT max(us) // 1000 * 1000 - 900000000 AS wm FROM mt"


@query("str_rate_rules", f"""WITH {METRICS}, {INC.format(w=60_000_000)}, w AS ({PASSED})
  SELECT win * 60000000 AS win_us, CAST(sum(increase) AS BIGINT) AS increase FROM incr, w
  WHERE label IN ('error', 'purchase') AND win * 60000000 + 60000000 <= wm
  GROUP BY win HAVING sum(increase) > 0""")
def str_rate_rules(spark, sf):
    """Increases come out of the live query window by window; the rule sums the chosen labels."""
    chosen = sample_stream(spark, sf).where(F.col("label").isin("error", "purchase"))
    rises = drain(spark, R.live_increase(chosen), "increases")
    return rises.groupBy("win_us").agg(F.sum("increase").alias("increase")).where(F.col("increase") > 0)


@query("str_offset_rule", f"""WITH {METRICS}, w AS ({PASSED}), l AS (SELECT us // 60000000 AS win, label,
    arg_max(value, ROW(us, event_id)) AS v FROM mt GROUP BY ALL), s AS (SELECT win, sum(v) AS now FROM l GROUP BY win)
  SELECT s.win * 60000000 AS win_us, CAST(s.now AS BIGINT) AS now,
    CAST(s.now - coalesce(p.now, 0) AS BIGINT) AS change
  FROM s LEFT JOIN s p ON p.win = s.win - 1, w
  WHERE s.now - coalesce(p.now, 0) > 0 AND s.win * 60000000 + 60000000 <= wm""")
def str_offset_rule(spark, sf):
    return drain(spark, R.live_offset(sample_stream(spark, sf)), "changes").where(F.col("change") > 0)


@query("str_alert_notify", f"""WITH RECURSIVE {V.PRED},
  e AS (SELECT component AS name, us, coalesce(CAST(actor AS VARCHAR), '') AS instance,
    row_number() OVER (PARTITION BY component ORDER BY us, coalesce(CAST(actor AS VARCHAR), '')) AS rn
    FROM pred WHERE prob >= 0.6),
  st AS (
    SELECT DISTINCT name, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS due, CAST(NULL AS BIGINT) AS last,
      CAST(NULL AS BIGINT) AS fired, CAST(0 AS BIGINT) AS pending, CAST([] AS VARCHAR[]) AS known,
      CAST(NULL AS BIGINT) AS n_us, CAST(NULL AS BIGINT) AS n_firings, CAST(NULL AS BOOLEAN) AS n_first FROM e
    UNION ALL
    SELECT name, rn, CASE WHEN last IS NULL THEN coalesce(due, us + {R.WAIT_US}) ELSE least(coalesce(due, us + 1000000000000000),
        greatest(us, last + CASE WHEN fresh THEN {R.INTERVAL_US} ELSE {R.REPEAT_US} END)) END,
      last, us, pending + 1, CASE WHEN fresh THEN list_append(known, instance) ELSE known END, n_us, n_firings, n_first
    FROM (SELECT *, NOT list_contains(known, instance) AS fresh FROM (
      SELECT * REPLACE (CASE WHEN over THEN NULL ELSE last END AS last, CASE WHEN over THEN [] ELSE known END AS known)
      FROM (SELECT *, due IS NULL AND last IS NOT NULL AND us - fired > {R.REPEAT_US} AS over FROM (
        SELECT st.name, e.rn, e.us, e.instance, st.fired, st.known,
          CASE WHEN due <= e.us THEN NULL ELSE due END AS due, CASE WHEN due <= e.us THEN due ELSE last END AS last,
          CASE WHEN due <= e.us THEN 0 ELSE pending END AS pending, CASE WHEN due <= e.us THEN due END AS n_us,
          CASE WHEN due <= e.us THEN pending END AS n_firings, CASE WHEN due <= e.us THEN last IS NULL END AS n_first
        FROM st JOIN e ON e.name = st.name AND e.rn = st.rn + 1))))),
  ends AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY name ORDER BY rn DESC) = 1)
  SELECT name AS alertname, n_us AS notify_us, n_firings AS firings, n_first AS first FROM st WHERE n_us IS NOT NULL
  UNION ALL SELECT name, due, pending, last IS NULL FROM ends
  WHERE due <= (SELECT max(us) // 1000 * 1000 - 900000000 FROM e)""")
def str_alert_notify(spark, sf):
    """Notifications with wait, interval and repeat, by event-time timers."""
    firings = V.predictions_from(event_stream(spark, sf)).where(F.col("prob") >= 0.6).select(
        "ts", "us", F.col("component").alias("alertname"), F.col("actor").cast("string").alias("instance"))
    return drain(spark, R.notifications(firings), "notes")
