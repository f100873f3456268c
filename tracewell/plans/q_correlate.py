"""Queries of alert correlation and monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import constants as K
from tracewell.operators import correlate as C
from tracewell.operators import monitor as M
from tracewell.operators.splits import halves
from tracewell.plans import sqltext as Q
from tracewell.plans import views as V
from tracewell.plans.q_joins import known_attackers
from tracewell.plans.q_sources import SYSCALL, syscall_lines
from tracewell.plans.registry import query
from tracewell.session import materialize, scratch_path
from tracewell.sources.readers import parse_syscall_lines
from tracewell.sources.writers import write_incidents

GAP = 3600  # seconds; the tables hold one event per actor and hour, so a minute would pair none
THRESHOLDS = [("c0", 0.05), ("c1", 0.1)]
CALIBRATORS = [("c0", 3.0, -1.0), ("c1", 2.0, -0.5)]

ALERTS = f"""{V.PRED}, al AS (SELECT row_id AS seq, us, actor, component, prob AS raw_score,
    CASE WHEN label = 1 THEN attack_type ELSE '' END AS hint FROM pred)"""
KEPT = f"""{ALERTS}, kp AS (SELECT *, CASE component WHEN 'c0' THEN 1 / (1 + exp(-(3.0 * raw_score - 1.0)))
    WHEN 'c1' THEN 1 / (1 + exp(-(2.0 * raw_score - 0.5))) ELSE raw_score END AS calibrated FROM al
    WHERE raw_score >= CASE component WHEN 'c0' THEN 0.05 WHEN 'c1' THEN 0.1 ELSE 0.5 END)"""


def sessions_sql(source: str, key: str = "actor", gap: int = GAP) -> str:
    """Assigned alerts (asg), incidents (inc), chain matches (ch) and final incidents (fin)."""
    k = f"PARTITION BY {key} ORDER BY us, seq"
    chain_cases = []
    for name, seq, boost in K.CHAINS:
        pattern = "(^|>)" + ">([a-z_]+>)*".join(seq) + "($|>)"
        chain_cases.append((name, boost, pattern))
    # Ties go to the catalogue order, so the cases are tried by boost, then position.
    chain_cases.sort(key=lambda c: -c[1])
    name_case = " ".join(f"WHEN regexp_matches(hints, '{p}') THEN '{n}'" for n, _, p in chain_cases)
    boost_case = " ".join(f"WHEN regexp_matches(hints, '{p}') THEN {b}" for _, b, p in chain_cases)
    return f"""lg AS (SELECT *, us - lag(us) OVER ({k}) AS step FROM {source}),
    gp AS (SELECT *, sum(CASE WHEN step IS NULL OR step > {gap * 1_000_000} THEN 1 ELSE 0 END)
      OVER ({k}) AS grp FROM lg),
    asg AS (SELECT *, min(us) OVER (PARTITION BY {key}, grp) AS start_us FROM gp),
    inc AS (SELECT {key}, start_us, max(us) AS end_us, CAST(count(*) AS BIGINT) AS n_alerts,
      string_agg(DISTINCT component, '|' ORDER BY component) AS components,
      CAST(count(*) FILTER (WHERE hint <> '') AS BIGINT) AS n_hints, max(calibrated) AS base_score,
      coalesce(string_agg(hint, '>' ORDER BY us, seq) FILTER (WHERE hint <> ''), '') AS hints
      FROM asg GROUP BY {key}, start_us),
    ch AS (SELECT *, CASE {name_case} END AS chain_matched, CASE {boost_case} END AS boost FROM inc),
    bo AS (SELECT *, CASE WHEN boost IS NULL THEN base_score ELSE least(base_score * boost, 1.0) END
      AS boosted_score FROM ch),
    fin AS (SELECT *, CASE WHEN boosted_score >= 0.95 THEN 'CRITICAL' WHEN boosted_score >= 0.85
      THEN 'HIGH' WHEN boosted_score >= 0.70 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM bo)"""


FINAL = f"{KEPT}, {sessions_sql('kp')}"


def alerts(spark, sf):
    return C.alerts_from_predictions(V.predictions(spark, sf))


def thresholds(spark):
    return spark.createDataFrame(THRESHOLDS, "component string, threshold double")


def calibrators(spark):
    return spark.createDataFrame(CALIBRATORS, "component string, coef double, intercept double")


def kept_alerts(spark, sf):
    return C.calibrate(C.apply_thresholds(alerts(spark, sf), thresholds(spark)), calibrators(spark))


def assigned(spark, sf):
    return C.assign_incidents(kept_alerts(spark, sf), gap_seconds=GAP)


def incidents(spark, sf):
    return C.correlate(alerts(spark, sf), thresholds(spark), calibrators(spark), gap_seconds=GAP)


@query("inc_from_predictions", f"WITH {ALERTS} SELECT * FROM al")
def inc_from_predictions(spark, sf):
    return alerts(spark, sf)


_KEYS = " ".join(
    "WHEN " + " OR ".join(f"contains(t, '{w}')" for w in words) + f" THEN '{tac}'"
    for words, tac in K.TACTIC_KEYWORDS)
_PRIO = " ".join(f"WHEN '{p}' THEN {s}" for p, s in K.PRIORITY_SCORE.items())


@query("inc_from_syscall", f"""WITH {V.EV}, {SYSCALL}, s AS (SELECT *, lower(concat(rule, ' output text')) AS t
    FROM sysc WHERE has_time)
  SELECT seq, us, CASE WHEN pod = '' THEN 'unknown' WHEN pod IN ('pod-1', 'pod-2') THEN concat('actor-', pod)
      ELSE concat('pod:', pod) END AS actor,
    'falco_runtime' AS component, CAST(CASE priority {_PRIO} ELSE 0.70 END AS DOUBLE) AS raw_score,
    CASE {_KEYS} ELSE '' END AS hint FROM s""")
def inc_from_syscall(spark, sf):
    pods = spark.createDataFrame([("pod-1", "actor-pod-1"), ("pod-2", "actor-pod-2")],
                                 "pod string, actor string")
    return C.alerts_from_syscalls(parse_syscall_lines(syscall_lines(spark, sf)), pods)


@query("inc_threshold", f"WITH {KEPT} SELECT seq, actor, component, raw_score FROM kp")
def inc_threshold(spark, sf):
    return C.apply_thresholds(alerts(spark, sf), thresholds(spark)).select(
        "seq", "actor", "component", "raw_score")


@query("inc_calibrate", f"WITH {KEPT} SELECT seq, component, calibrated FROM kp",
       rounded=("calibrated",))
def inc_calibrate(spark, sf):
    return kept_alerts(spark, sf).select("seq", "component", "calibrated")


@query("inc_sessionize", f"WITH {FINAL} SELECT seq, actor, start_us FROM asg")
def inc_sessionize(spark, sf):
    return assigned(spark, sf).select("seq", "actor", "start_us")


@query("inc_assemble", f"""WITH {FINAL} SELECT actor, start_us, end_us, n_alerts, components, n_hints,
  base_score FROM inc""",
       rounded=("base_score",))
def inc_assemble(spark, sf):
    return C.assemble(assigned(spark, sf))


@query("inc_sequence", f"""WITH {FINAL}, hp AS (SELECT *, (row_number() OVER (PARTITION BY actor, start_us
    ORDER BY us, seq) - 1) // 3 AS part FROM asg WHERE hint <> '')
  SELECT actor, start_us, CAST(part AS BIGINT) AS part, string_agg(hint, '>' ORDER BY us, seq) AS hints
  FROM hp GROUP BY 1, 2, 3""")
def inc_sequence(spark, sf):
    return C.incident_sequence(assigned(spark, sf), part_rows=3).withColumn(
        "hints", F.array_join("hints", ">"))


@query("inc_chain_match", f"""WITH {FINAL} SELECT actor, start_us, chain_matched, CAST(boost AS DOUBLE) AS boost
  FROM ch WHERE chain_matched IS NOT NULL""")
def inc_chain_match(spark, sf):
    return C.match_chains(assigned(spark, sf))


@query("inc_boost", f"WITH {FINAL} SELECT actor, start_us, base_score, boosted_score FROM fin",
       rounded=("base_score", "boosted_score"))
def inc_boost(spark, sf):
    return incidents(spark, sf).select("actor", "start_us", "base_score", "boosted_score")


@query("inc_severity", f"WITH {FINAL} SELECT actor, start_us, severity, chain_matched FROM fin")
def inc_severity(spark, sf):
    return incidents(spark, sf).select("actor", "start_us", "severity", "chain_matched")


@query("inc_score", f"""WITH {FINAL}, t AS (SELECT DISTINCT actor FROM pred WHERE label = 1 AND attack_type = 'discovery' AND prob >= 0.8),
  f AS (SELECT DISTINCT actor FROM fin),
  c AS (SELECT CAST(count(*) FILTER (WHERE t.actor IS NOT NULL AND f.actor IS NOT NULL) AS BIGINT) AS tp,
    CAST(count(*) FILTER (WHERE t.actor IS NULL) AS BIGINT) AS fp,
    CAST(count(*) FILTER (WHERE f.actor IS NULL) AS BIGINT) AS fn FROM t FULL JOIN f ON t.actor = f.actor),
  i AS (SELECT CAST(count(*) AS BIGINT) AS incidents, CAST(count(*) FILTER (WHERE n_hints > 0) AS BIGINT)
    AS incidents_with_attack, CAST(count(chain_matched) AS BIGINT) AS incidents_with_chain FROM fin)
  SELECT *, round_even(tp / greatest(tp + fp, 1), 4) AS precision,
    round_even(tp / greatest(tp + fn, 1), 4) AS recall,
    round_even(incidents_with_attack / greatest(incidents, 1), 4) AS incident_precision FROM c, i""")
def inc_score(spark, sf):
    truth = V.predictions(spark, sf).where(known_attackers())
    return C.score_incidents(incidents(spark, sf), truth)


@query("agg_alert_volume", f"""WITH {FINAL}, r AS (SELECT count(*) AS raw FROM al), n AS (SELECT count(*) AS inc FROM fin)
  SELECT 'raw_alerts' AS measure, CAST(raw AS DOUBLE) AS value FROM r
  UNION ALL SELECT 'incidents', CAST(inc AS DOUBLE) FROM n
  UNION ALL SELECT 'dedup_ratio', round_even(1 - inc / greatest(raw, 1), 4) FROM r, n
  UNION ALL SELECT concat('severity:', severity), CAST(count(*) AS DOUBLE) FROM fin GROUP BY severity
  UNION ALL SELECT concat('chain:', chain_matched), CAST(count(*) AS DOUBLE) FROM fin
    WHERE chain_matched IS NOT NULL GROUP BY chain_matched
  UNION ALL SELECT concat('attack_type:', hint), CAST(count(*) AS DOUBLE) FROM al WHERE hint <> '' GROUP BY hint""")
def agg_alert_volume(spark, sf):
    return C.alert_volume(alerts(spark, sf), incidents(spark, sf))


PLANES = {"audit": ["audit"], "syscall": ["syscall"], "both": ["audit", "syscall"]}


@query("inc_plane_comparison", f"""WITH {ALERTS}, pl AS (SELECT *, raw_score AS calibrated,
    CASE WHEN component = 'c2' THEN 'syscall' ELSE 'audit' END AS plane FROM al),
  ps AS (SELECT plane AS plane_set, * EXCLUDE (plane) FROM pl UNION ALL
    SELECT 'both', * EXCLUDE (plane) FROM pl),
  px AS (SELECT concat(plane_set, '/', actor) AS ka, * FROM ps), {sessions_sql('px', 'ka')}
  SELECT string_split(ka, '/')[1] AS plane_set, CAST(count(*) AS BIGINT) AS incidents,
    CAST(count(chain_matched) AS BIGINT) AS with_chain,
    CAST(count(*) FILTER (WHERE severity = 'CRITICAL') AS BIGINT) AS critical,
    max(boosted_score) AS top_score FROM fin GROUP BY 1""")
def inc_plane_comparison(spark, sf):
    df = alerts(spark, sf).withColumn(
        "plane", F.when(F.col("component") == "c2", "syscall").otherwise("audit"))
    return C.plane_comparison(df, PLANES, GAP)


@query("sink_incidents", f"""WITH {FINAL} SELECT actor, start_us, n_alerts, severity,
  round(boosted_score, 9) AS boosted_score FROM fin""")
def sink_incidents(spark, sf):
    path = scratch_path(spark, "incidents")
    write_incidents(incidents(spark, sf), path)
    back = spark.read.schema("actor string, start_us bigint, n_alerts bigint, severity string, "
                             "boosted_score double").json(path)
    return back.withColumn("boosted_score", F.round("boosted_score", 9))


@query("correlation_report", f"""WITH {V.PRED}, h AS (SELECT *, row_number() OVER (PARTITION BY component
    ORDER BY row_id) > count(*) OVER (PARTITION BY component) // 2 AS late FROM pred),
  {Q.points_cte('(SELECT * FROM h WHERE NOT late)', 'component')},
  r AS (SELECT component, max(threshold) AS t FROM (SELECT *, max(tp) OVER (PARTITION BY component) AS m
    FROM pts WHERE fp / neg <= 0.05) WHERE tp = m GROUP BY component),
  al AS (SELECT row_id AS seq, us, actor, h.component, prob AS raw_score, prob AS calibrated,
    CASE WHEN label = 1 THEN attack_type ELSE '' END AS hint FROM h LEFT JOIN r
    ON h.component = r.component WHERE late AND prob >= coalesce(t, 0.5)), {sessions_sql('al')}
  SELECT severity, CAST(count(*) AS BIGINT) AS incidents, CAST(sum(n_alerts) AS BIGINT) AS alerts
  FROM fin GROUP BY severity""")
def correlation_report(spark, sf):
    """Half split, threshold at the FPR budget on one half, incidents of the other half."""
    from tracewell.operators.evaluate import score_points, threshold_at_fpr
    df = halves(V.predictions(spark, sf), keys=["component"])
    cal = df.where(F.col("half") == "calibration")
    thr = materialize(threshold_at_fpr(score_points(cal, keys=["component"]), 0.05, ["component"]))
    test = C.alerts_from_predictions(df.where(F.col("half") == "evaluation"))
    out = C.correlate(test, thr, gap_seconds=GAP)
    return out.groupBy("severity").agg(F.count(F.lit(1)).alias("incidents"),
                                       F.sum("n_alerts").alias("alerts"))


# ---- monitoring -----------------------------------------------------------------------------

# Counter table: running event counts per type, one restart half way through the month.
RESTART = 1_705_276_800_000_000
METRICS = f"""{V.EV}, mt AS (SELECT us, 'events_total' AS metric, event_type AS label, event_id,
  CAST(count(*) OVER (PARTITION BY event_type, us >= {RESTART} ORDER BY us, event_id) AS BIGINT) AS value
  FROM ev)"""


def metrics(spark, sf):
    """The running counts come from chunked sums, so a busy label is spread over tasks."""
    from tracewell.operators.partition import running_totals
    ev = V.events(spark, sf).select(
        "us", F.lit("events_total").alias("metric"), F.col("event_type").alias("label"), "event_id",
        (F.col("us") >= RESTART).alias("late"))
    out = running_totals(ev, [F.col("us"), F.col("event_id")], F.floor(F.col("us") / 3_600_000_000),
                         {"value": F.lit(1)}, ["label", "late"])
    return out.select("us", F.col("event_id").alias("seq"), "metric", "label", "value")


INC = """lastv AS (SELECT metric, label, us // {w} AS win, arg_max(value, ROW(us, event_id)) AS v FROM mt GROUP BY ALL),
  stp AS (SELECT *, lag(v) OVER (PARTITION BY metric, label ORDER BY win) AS p FROM lastv),
  incr AS (SELECT metric, label, win, CAST(CASE WHEN p IS NULL OR v < p THEN v ELSE v - p END AS BIGINT) AS increase
    FROM stp)"""


@query("mon_total", f"""WITH {METRICS}, l AS (SELECT label, arg_max(value, ROW(us, event_id)) AS v FROM mt GROUP BY label)
  SELECT CAST(coalesce(sum(v), 0) AS BIGINT) AS total FROM l""")
def mon_total(spark, sf):
    return M.total(metrics(spark, sf), "events_total")


@query("mon_increase", f"""WITH {METRICS}, {INC.format(w=120_000_000)}
  SELECT metric, label, win * 120000000 AS win_us, increase FROM incr""")
def mon_increase(spark, sf):
    return M.increase(metrics(spark, sf), 2)


@query("mon_distinct_pods", f"WITH {V.EV}, {SYSCALL} SELECT CAST(count(DISTINCT pod) AS BIGINT) AS pods FROM sysc")
def mon_distinct_pods(spark, sf):
    return M.distinct_pods(_syscalls(spark, sf))


def _syscalls(spark, sf):
    return parse_syscall_lines(syscall_lines(spark, sf)).withColumn(
        "pod", F.try_element_at("output_fields", F.lit("k8s.pod.name")))


@query("mon_by_priority", f"""WITH {V.EV}, {SYSCALL} SELECT priority, CAST(count(*) AS BIGINT) AS total
  FROM sysc GROUP BY priority""")
def mon_by_priority(spark, sf):
    return M.sum_by(_syscalls(spark, sf), "priority")


@query("mon_table", f"""WITH {V.EV}, {SYSCALL} SELECT pod, rule, priority, CAST(count(*) AS BIGINT) AS total
  FROM sysc GROUP BY ALL""")
def mon_table(spark, sf):
    return M.sum_by(_syscalls(spark, sf), "pod", "rule", "priority")


@query("mon_up", f"""WITH {V.EV} SELECT event_type AS job, CAST(min(CASE WHEN value > 0.02 THEN 1 ELSE 0 END) AS INT)
  AS up FROM ev GROUP BY event_type""")
def mon_up(spark, sf):
    df = V.events(spark, sf).select(
        F.col("event_type").alias("job"), F.when(F.col("value") > 0.02, 1).otherwise(0).alias("up"))
    return M.up(df)


@query("mon_rate_rule", f"""WITH {METRICS}, {INC.format(w=60_000_000)}
  SELECT win * 60000000 AS win_us, CAST(sum(increase) AS BIGINT) AS increase FROM incr
  WHERE label IN ('error', 'purchase') GROUP BY win HAVING sum(increase) > 0""")
def mon_rate_rule(spark, sf):
    return M.rate_rule(metrics(spark, sf), ["error", "purchase"])


@query("mon_offset_rule", f"""WITH {METRICS}, l AS (SELECT us // 60000000 AS win, label,
    arg_max(value, ROW(us, event_id)) AS v FROM mt GROUP BY ALL), s AS (SELECT win, sum(v) AS now FROM l GROUP BY win)
  SELECT s.win * 60000000 AS win_us, CAST(s.now AS BIGINT) AS now,
    CAST(s.now - coalesce(p.now, 0) AS BIGINT) AS change
  FROM s LEFT JOIN s p ON p.win = s.win - 1 WHERE s.now - coalesce(p.now, 0) > 0""")
def mon_offset_rule(spark, sf):
    return M.offset_rule(metrics(spark, sf))


@query("str_alert_grouping", f"""WITH {V.PRED}, l AS (SELECT component AS alertname, us, row_id,
    us - lag(us) OVER (PARTITION BY component ORDER BY us, row_id) AS step FROM pred WHERE prob >= 0.6),
  g AS (SELECT *, sum(CASE WHEN step IS NULL OR step > 1800000000 THEN 1 ELSE 0 END) OVER (
    PARTITION BY alertname ORDER BY us, row_id) AS run FROM l),
  r AS (SELECT *, min(us) OVER (PARTITION BY alertname, run) AS run_us FROM g)
  SELECT alertname, run_us, CAST((us - run_us) // 1800000000 AS BIGINT) AS tick, min(us) AS notify_us,
    CAST(count(*) AS BIGINT) AS firings FROM r GROUP BY 1, 2, 3""")
def str_alert_grouping(spark, sf):
    df = V.predictions(spark, sf).where(F.col("prob") >= 0.6).withColumnRenamed(
        "component", "alertname")
    return M.suppress_repeats(df)
