"""Queries of the look-back window features, and the flagship actor ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import constants as K
from tracewell.functions import predicates as P
from tracewell.operators import aggregates as A
from tracewell.operators import rules as RU
from tracewell.operators import windows as W
from tracewell.operators.joins import novel_anti
from tracewell.operators.normalize import category_label, last_segment
from tracewell.operators.splits import tool_part
from tracewell.plans import sqltext as Q
from tracewell.plans import views as V
from tracewell.plans.q_sources import SYSCALL, labelled_features, syscall_lines
from tracewell.plans.registry import query
from tracewell.session import written_table
from tracewell.sources.readers import parse_syscall_lines


def features(spark, sf):
    return W.window_features(V.audit(spark, sf))


def scored_windows(spark, sf):
    """Labelled feature windows with partition, short identity and a deterministic score."""
    f = labelled_features(spark, sf)
    score = (F.col("severity") * 7 + F.col("n_forbid") * 3 + F.col("n_delete") * 5
             + F.col("k") % 10) / 130.0
    return f.withColumns({
        "uid": last_segment(F.col("user")), "prob": score.cast("double"),
        "part": tool_part(F.col("tool"), F.col("user"), F.col("session"))})


def scored_table(spark, sf):
    """The scored windows as a written table, for queries that branch over them."""
    return written_table(scored_windows(spark, sf), "windows")


def with_category(df):
    return df.withColumn("category", category_label(F.col("part"), F.col("label"), F.col("user")))


def _feature_query(name, cols):
    @query(name, f"WITH {Q.FEATURES} SELECT audit_id, {', '.join(cols)} FROM feat")
    def run(spark, sf):
        return features(spark, sf).select("audit_id", *cols)
    return run


_feature_query("win_counts", ["n_events", "n_forbid", "n_secrets", "n_exec", "n_rbac", "n_create",
                              "n_delete", "n_list", "n_4xx", "n_selfreview", "n_create_workload"])
_feature_query("win_ratios", ["forbid_ratio", "secret_rate", "rbac_rate", "create_rate",
                              "selfreview_ratio"])
_feature_query("win_distinct", ["n_distinct_resource", "n_distinct_verb", "n_distinct_ns",
                                "n_distinct_impersonated", "secret_ns"])
_feature_query("win_presence", ["has_secret", "has_exec", "has_rbac_write", "has_crb", "has_forbid",
                                "has_impersonation", "has_csr", "has_tokenreq"])
_feature_query("win_severity", ["severity"])
_feature_query("win_cumulative", ["cum_secrets", "cum_rbac_w", "cum_exec", "cum_crb"])
_feature_query("win_features_all", K.ALL_FEATURES)


@query("win_predicates", f"""WITH {V.AUDIT} SELECT audit_id, {Q.PRED_SECRET} AS secret_read,
  {Q.PRED_RBW} AS rbac_write, {Q.PRED_CRB} AS binding_create, {Q.PRED_WORKLOAD} AS workload_create,
  {Q.PRED_CSR} AS signing_request, {Q.PRED_TOKEN} AS token_request, {Q.PRED_REVIEW} AS self_review
  FROM audit""")
def win_predicates(spark, sf):
    return P.with_predicates(V.audit(spark, sf)).select("audit_id", *P.PREDICATES)


@query("win_rich14", f"WITH {Q.FEATURES} SELECT audit_id, {', '.join(W.RICH_FEATURES)} FROM feat")
def win_rich14(spark, sf):
    return W.rich_features(V.audit(spark, sf)).select("audit_id", *W.RICH_FEATURES)


@query("win_burst_max", f"""WITH {V.AUDIT}, n AS (SELECT audit_id, session, actor,
    row_number() OVER (PARTITION BY session, actor ORDER BY us, audit_id) AS pos,
    CAST({Q.PRED_REVIEW} AS INT) AS f FROM audit),
  g AS (SELECT *, sum(1 - f) OVER (PARTITION BY session, actor ORDER BY pos) AS island FROM n),
  r AS (SELECT a.audit_id, b.island, count(*) AS run FROM g a JOIN g b
    ON a.session = b.session AND a.actor = b.actor AND b.pos BETWEEN a.pos - 19 AND a.pos
    WHERE b.f = 1 GROUP BY 1, 2),
  m AS (SELECT audit_id, max(run) AS best FROM r GROUP BY 1)
  SELECT audit_id, CAST(coalesce(best, 0) AS BIGINT) AS burst_max FROM g LEFT JOIN m USING (audit_id)""")
def win_burst_max(spark, sf):
    return W.longest_burst(V.audit(spark, sf)).select("audit_id", "burst_max")


RANGED = f"""{V.AUDIT}, p AS (SELECT *, row_number() OVER (PARTITION BY actor ORDER BY us, audit_id)
    AS pos FROM audit),
  j AS (SELECT a.audit_id, b.us AS b_us, a.us, b.resource, b.verb, b.code FROM p a JOIN p b
    ON a.actor = b.actor AND b.pos <= a.pos AND b.us >= a.us - 60000000)"""


@query("win_time_counts", f"""WITH {RANGED} SELECT audit_id,
  CAST(count(*) FILTER (WHERE b_us >= us - 5000000) AS BIGINT) AS events_5s,
  CAST(count(*) AS BIGINT) AS events_60s FROM j GROUP BY audit_id""")
def win_time_counts(spark, sf):
    return W.time_features(V.audit(spark, sf)).select("audit_id", "events_5s", "events_60s")


@query("win_time_distinct", f"""WITH {RANGED} SELECT audit_id,
  CAST(count(DISTINCT resource) AS BIGINT) AS distinct_resources_60s,
  CAST(count(DISTINCT verb) AS BIGINT) AS distinct_verbs_60s,
  CAST(count(*) FILTER (WHERE code >= 400) AS BIGINT) AS errors_60s,
  CAST(count(*) FILTER (WHERE verb IN ('get', 'list', 'watch')) AS DOUBLE) / count(*)
    AS readonly_ratio_60s FROM j GROUP BY audit_id""")
def win_time_distinct(spark, sf):
    return W.time_features(V.audit(spark, sf)).select(
        "audit_id", "distinct_resources_60s", "distinct_verbs_60s", "errors_60s",
        "readonly_ratio_60s")


@query("win_gap_prev", f"""WITH {V.AUDIT} SELECT audit_id,
  coalesce((us - lag(us) OVER (PARTITION BY actor ORDER BY us, audit_id)) / 1e6, -1.0)
    AS secs_since_prev FROM audit""")
def win_gap_prev(spark, sf):
    return W.time_features(V.audit(spark, sf)).select("audit_id", "secs_since_prev")


@query("win_token_seq", f"""WITH {V.AUDIT}, t AS (SELECT audit_id, list(concat(verb, ':', resource,
    ':', sub)) OVER (PARTITION BY session, actor ORDER BY us, audit_id
    ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS l FROM audit)
  SELECT audit_id, array_to_string(list_concat(list_transform(range(20 - len(l)), lambda x: '<PAD>'), l), ' ') AS tokens
  FROM t""")
def win_token_seq(spark, sf):
    return W.token_windows(V.audit(spark, sf)).select(
        "audit_id", F.array_join("tokens", " ").alias("tokens"))


@query("win_last_event", f"""WITH {Q.FEATURES}, r AS (SELECT *, row_number() OVER (
    PARTITION BY session, actor ORDER BY us DESC, audit_id DESC) AS rn FROM feat)
  SELECT session, actor, audit_id, {', '.join(K.ALL_FEATURES)} FROM r WHERE rn = 1""")
def win_last_event(spark, sf):
    return W.last_window(features(spark, sf)).select("session", "actor", "audit_id", *K.ALL_FEATURES)


# ---- episodes and rules ---------------------------------------------------------------------

_SIGNALS = {
    "rule_f": "(has_crb >= 1 OR has_exec >= 1 OR has_impersonation >= 1 "
              "OR (has_secret >= 1 AND secret_ns >= 2))",
    "rule_recon": "n_selfreview >= 5", "rule_destruct": "n_delete >= 5",
    "rule_hijack": "n_create_workload >= 1", "rule_persist": "(has_csr >= 1 OR has_tokenreq >= 1)",
}
_ODD = "(" + " OR ".join(v for n, v in _SIGNALS.items() if n != "rule_f") + ")"
_VECS = ", ".join(f"round_even(CAST({c} AS DOUBLE), 4)" for c in Q.VEC)
RULE_SQL = f"""{Q.LABELLED}, known AS (SELECT DISTINCT actor FROM lab1 WHERE label = 0 AND allowed),
  trainpos AS (SELECT DISTINCT ROW({_VECS}) AS v FROM lab1 WHERE part = 'train' AND label = 1),
  lab AS (SELECT *, ROW({_VECS}) NOT IN (SELECT v FROM trainpos) AS novel FROM lab1),
  ep0 AS (SELECT part, session, uid, min(actor) AS actor, max(label) AS label,
    CAST(count(*) AS BIGINT) AS n_windows,
    CAST(count(*) FILTER (WHERE prob >= 0.5) AS BIGINT) AS fired,
    CAST(count(*) FILTER (WHERE prob >= 0.5 AND novel) AS BIGINT) AS fired_novel,
    bool_or(allowed) AS allowed, bool_or(recon) AS recon,
    {', '.join(f'bool_or({c}) AS s_{n}' for n, c in _SIGNALS.items())},
    bool_or({_ODD}) AS s_anom FROM lab GROUP BY part, session, uid),
  ep1 AS (SELECT *, fired >= 2 AND NOT allowed AS clf, fired_novel >= 2 AND NOT allowed AS clf_novel,
    {', '.join(f's_{n} AND NOT allowed AS {n}' for n in _SIGNALS)},
    s_anom AND allowed AND starts_with(actor, 'system:serviceaccount:')
      AND actor NOT IN (SELECT actor FROM known) AS rule_anom FROM ep0),
  ep AS (SELECT *, clf OR {' OR '.join(RU.RULES)} AS rule_full,
    clf_novel OR {' OR '.join(RU.RULES)} AS full_novel FROM ep1)"""


def rule_episodes(spark, sf):
    """Episodes with every rule, straight from the windows: nothing is written, novelty isn't asked."""
    return RU.episode_rules(scored_windows(spark, sf))


def novel_windows(df):
    """Flags windows ``novel`` when no train attack has the same vector."""
    from tracewell.operators.joins import vector_columns, vector_keys
    keys = vector_keys(K.EVAL_FEATURES)
    vec = vector_columns(df, K.EVAL_FEATURES)
    seen = (vec.where((F.col("part") == "train") & (F.col("label") == 1)).select(*keys).distinct()
            .withColumn("_seen", F.lit(True)))
    return (vec.join(seen, keys, "left").withColumn("novel", F.col("_seen").isNull())
            .select(*df.columns, "novel"))


def _rule_query(name, column):
    @query(name, f"WITH {RULE_SQL} SELECT part, session, uid, {column} FROM ep")
    def run(spark, sf):
        return rule_episodes(spark, sf).select("part", "session", "uid", column)
    return run


for _r in [*RU.RULES, "rule_full"]:
    _rule_query("rule_F" if _r == "rule_f" else _r, _r)


@query("actor_ranking", f"""WITH {RULE_SQL} SELECT actor AS "user",
  CAST(count(*) AS BIGINT) AS episodes, CAST(sum(n_windows) AS BIGINT) AS windows,
  CAST(sum(fired) AS BIGINT) AS fired, CAST(count(*) FILTER (WHERE clf) AS BIGINT) AS clf_episodes,
  CAST(count(*) FILTER (WHERE rule_full) AS BIGINT) AS alarmed FROM ep GROUP BY actor""")
def actor_ranking(spark, sf):
    return rule_episodes(spark, sf).groupBy("user").agg(
        F.count(F.lit(1)).alias("episodes"), F.sum("n_windows").alias("windows"),
        F.sum("fired").alias("fired"), F.count_if("clf").alias("clf_episodes"),
        F.count_if("rule_full").alias("alarmed")).orderBy(F.desc("fired"), "user")


TOKENS = f"""{V.AUDIT}, tk AS (SELECT *, list(concat(verb, ':', resource, ':', sub)) OVER (
    PARTITION BY session, actor ORDER BY us, audit_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)
    AS tokens FROM audit)"""


def token_table(spark, sf):
    return W.token_windows(V.audit(spark, sf))


@query("rule_keyword", f"""WITH {TOKENS} SELECT audit_id,
  list_has_any(tokens, [{Q.names(K.SIGNATURE_TOKENS)}]) AS signature,
  list_has_any(tokens, [{Q.names(K.DISTINCT_TOKENS)}]) AS distinctive FROM tk""")
def rule_keyword(spark, sf):
    return token_table(spark, sf).select(
        "audit_id", RU.keyword_rule().alias("signature"),
        RU.keyword_rule(short=True).alias("distinctive"))


SINGLE = f"""{Q.LABELLED}, sy AS (SELECT *, CASE WHEN contains(actor, 'recon-sa') THEN 1
    WHEN label = 0 THEN 0 END AS y FROM lab1),
  rr AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS prob, y AS label FROM sy WHERE y IS NOT NULL"
                             for f in RU.REVIEW_FEATURES)}), {Q.points_cte('rr', 'feature')},
  sg AS (SELECT *, tp / pos AS rec, fp / neg AS f, row_number() OVER (PARTITION BY feature
    ORDER BY tp / pos - fp / neg DESC, threshold) AS rn FROM pts),
  single AS (SELECT feature, threshold, rec AS recall, f AS fpr FROM sg WHERE rn = 1)"""


def single_features(df):
    return RU.best_single_threshold(df, RU.REVIEW_FEATURES, F.col("user").contains("recon-sa"),
                                    F.col("label") == 0)


@query("rule_single_feature", f"WITH {SINGLE} SELECT * FROM single")
def rule_single_feature(spark, sf):
    return single_features(scored_windows(spark, sf))


def _rate(p, cond):
    return f"avg(CASE WHEN {cond} THEN CAST({p} AS INT) END)"


_BASE = {"model": "prob >= 0.5", "presence": "n_selfreview >= 1",
         "identity": "contains(actor, 'recon-sa')",
         "shape": "starts_with(actor, 'system:serviceaccount')"}
_IS_RECON = "contains(actor, 'recon-sa')"
_RATES = ", ".join(
    f"{_rate(p, _IS_RECON)} AS {n}_recall, "
    f"{_rate(p, 'label = 0')} AS {n}_fpr" for n, p in _BASE.items())


@query("rule_leakage_gate", f"""WITH {SINGLE}, b AS (SELECT {_RATES},
    avg(CAST((prob >= 0.5) = (n_selfreview >= 1) AS INT)) AS agreement,
    avg(CASE WHEN label = 0 AND n_selfreview >= 1 THEN CAST(prob < 0.5 AS INT) END) AS reviewers_spared,
    (SELECT max(recall) FROM single) AS best_single_recall FROM lab1)
  SELECT *, CASE WHEN model_fpr < presence_fpr - 0.03 AND model_recall >= best_single_recall - 0.02
    AND agreement < 0.95 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM b""")
def rule_leakage_gate(spark, sf):
    df = scored_table(spark, sf)
    return RU.leakage_gate(RU.baseline_rates(df), single_features(df))


@query("rule_identity_only", f"""WITH {V.PRED}, a AS (SELECT actor, CAST(round_even(avg(label), 0) AS INT)
    AS pred, CAST(count(*) AS BIGINT) AS rows, CAST(sum(label) AS BIGINT) AS attacks FROM pred GROUP BY actor)
  SELECT *, CAST(CASE WHEN pred = 1 THEN attacks ELSE rows - attacks END AS BIGINT) AS correct FROM a""")
def rule_identity_only(spark, sf):
    return RU.identity_only(V.predictions(spark, sf))


# ---- aggregates over windows and episodes ---------------------------------------------------

@query("agg_by_tool", f"""WITH {V.AUDIT}, t AS (SELECT {Q.TOOL} AS tool FROM audit)
  SELECT tool, CAST(count(*) AS BIGINT) AS windows FROM t GROUP BY tool""")
def agg_by_tool(spark, sf):
    return A.count_by(labelled_features(spark, sf), "tool", name="windows")


@query("agg_class_balance", f"""WITH {V.FLOW}, c AS (SELECT label, CAST(count(*) AS BIGINT) AS rows,
    lower(trim(label)) NOT IN ({Q.names(K.BENIGN_LABELS)}) AS y FROM flow GROUP BY label),
  t AS (SELECT *, CAST(sum(CASE WHEN y THEN 0 ELSE rows END) OVER () AS BIGINT) AS benign,
    CAST(sum(CASE WHEN y THEN rows ELSE 0 END) OVER () AS BIGINT) AS attack FROM c),
  r AS (SELECT label, rows, benign, attack, least(benign, attack) / greatest(benign, attack)
    AS minority_ratio, 100.0 * rows / (benign + attack) AS percent FROM t)
  SELECT *, CASE WHEN minority_ratio >= 0.9 THEN 'HIGHLY BALANCED' WHEN minority_ratio >= 0.7
    THEN 'MODERATELY BALANCED' WHEN minority_ratio >= 0.5 THEN 'SLIGHTLY IMBALANCED'
    WHEN minority_ratio >= 0.3 THEN 'IMBALANCED' ELSE 'HIGHLY IMBALANCED' END AS verdict FROM r""")
def agg_class_balance(spark, sf):
    from tracewell.operators.flow import label_binary
    df = V.flows(spark, sf)
    return A.class_balance(df, "label", label_binary(df, "label"))


@query("agg_events_per_actor", f"""WITH {V.AUDIT} SELECT actor, CAST(count(*) AS BIGINT) AS events
  FROM audit GROUP BY actor ORDER BY events DESC, actor LIMIT 12""")
def agg_events_per_actor(spark, sf):
    return A.top_actors(V.audit(spark, sf), 12)


@query("agg_verb_resource_top", f"""WITH {V.AUDIT}, e AS (SELECT session, actor,
    CAST(count(*) FILTER (WHERE decision = 'forbid') AS BIGINT) AS n_forbid,
    CAST(count(*) FILTER (WHERE resource = 'secrets') AS BIGINT) AS n_secrets,
    CAST(count(*) FILTER (WHERE sub = 'exec') AS BIGINT) AS n_exec,
    CAST(count(*) FILTER (WHERE resource IN ({Q.RBAC})) AS BIGINT) AS n_rbac
    FROM audit GROUP BY 1, 2),
  c AS (SELECT session, actor, verb, resource, decision, CAST(count(*) AS BIGINT) AS calls
    FROM audit GROUP BY ALL),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY session, actor
    ORDER BY calls DESC, verb, resource, decision) AS INT) AS rank FROM c)
  SELECT r.*, n_forbid, n_secrets, n_exec, n_rbac FROM r JOIN e USING (session, actor)
  WHERE rank <= 8""")
def agg_verb_resource_top(spark, sf):
    return A.episode_top_calls(V.audit(spark, sf))


@query("agg_rule_by_pod", f"""WITH {V.EV}, {SYSCALL} SELECT pod, rule,
  CAST(count(*) AS BIGINT) AS alerts FROM sysc GROUP BY pod, rule""")
def agg_rule_by_pod(spark, sf):
    df = parse_syscall_lines(syscall_lines(spark, sf)).withColumn(
        "pod", F.try_element_at("output_fields", F.lit("k8s.pod.name")))
    return A.count_by(df, "pod", "rule", name="alerts")


EPISODES = f"""{Q.LABELLED}, eps AS (SELECT part, session, uid, CAST(count(*) AS BIGINT) AS n_windows,
    CAST(count(*) FILTER (WHERE prob >= 0.5) AS BIGINT) AS fired, max(prob) AS max_prob,
    avg(prob) AS mean_prob, max(label) AS label, bool_or(has_secret = 1) AS any_secret,
    bool_or(has_exec = 1) AS any_exec, bool_or(has_crb = 1) AS any_crb
    FROM lab1 GROUP BY part, session, uid)"""


@query("agg_episode", f"WITH {EPISODES} SELECT * FROM eps",
       rounded=("mean_prob",))
def agg_episode(spark, sf):
    return A.episodes(scored_windows(spark, sf))


@query("agg_hysteresis", f"WITH {EPISODES} SELECT part, session, uid, fired, fired >= 2 AS alert FROM eps")
def agg_hysteresis(spark, sf):
    return A.hysteresis(A.episodes(scored_windows(spark, sf))).select(
        "part", "session", "uid", "fired", "alert")


@query("agg_hysteresis_sweep", f"""WITH {EPISODES} SELECT CAST(k AS INT) AS k,
  CAST(count(*) FILTER (WHERE label = 1 AND fired >= k) AS DOUBLE)
    / count(*) FILTER (WHERE label = 1) AS recall,
  CAST(count(*) FILTER (WHERE label = 0 AND fired >= k) AS DOUBLE)
    / count(*) FILTER (WHERE label = 0) AS fpr
  FROM eps, UNNEST([1, 2, 3, 5, 10]) AS u(k) GROUP BY k""")
def agg_hysteresis_sweep(spark, sf):
    return A.hysteresis_sweep(A.episodes(scored_windows(spark, sf)))


@query("agg_detect_by_actor", f"""WITH {EPISODES}, d AS (SELECT uid,
    CAST(count(*) FILTER (WHERE fired >= 1) AS BIGINT) AS caught_k1,
    CAST(count(*) FILTER (WHERE fired >= 2) AS BIGINT) AS caught_k2,
    CAST(count(*) AS BIGINT) AS episodes FROM eps WHERE label = 1 GROUP BY uid)
  SELECT *, caught_k1 / episodes AS recall_k1, caught_k2 / episodes AS recall_k2 FROM d""")
def agg_detect_by_actor(spark, sf):
    return A.detect_by_actor(A.episodes(scored_windows(spark, sf)))


TRAJ = f"""{RULE_SQL}, tr AS (SELECT part, session, uid,
    list(ROW({_VECS}) ORDER BY us, audit_id) AS sig FROM lab1 GROUP BY part, session, uid),
  cat0 AS (SELECT ep.*, sig, {Q.CATEGORY} AS category FROM ep JOIN tr USING (part, session, uid)),
  cat AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category, sig
    ORDER BY part, session, uid) AS rn FROM cat0 WHERE category IS NOT NULL) WHERE rn = 1)"""


def distinct_episodes(spark, sf):
    """Categorised episodes with identical trajectories collapsed."""
    windows = scored_table(spark, sf)
    eps = with_category(RU.episode_rules(novel_windows(windows))).where(F.col("category").isNotNull())
    sig = A.trajectory_signature(windows, K.EVAL_FEATURES)
    return A.distinct_trajectories(eps.join(sig, A.EPISODE))


@query("agg_trajectory_distinct", f"""WITH {TRAJ} SELECT category, CAST(count(*) AS BIGINT) AS episodes
  FROM cat GROUP BY category""")
def agg_trajectory_distinct(spark, sf):
    return A.count_by(distinct_episodes(spark, sf), "category", name="episodes")


MATRIX_RULES = ["clf", "clf_novel", *RU.RULES, "rule_full", "full_novel"]
_WILSON = """CASE WHEN total = 0 THEN 0 ELSE greatest(0, (detected / total + 1.96 * 1.96 / (2 * total)
  - 1.96 * sqrt((detected / total) * (1 - detected / total) / total
    + 1.96 * 1.96 / (4 * CAST(total AS DOUBLE) * total))) / (1 + 1.96 * 1.96 / total)) END"""


@query("agg_rule_matrix", f"""WITH {TRAJ}, m AS (""" + " UNION ALL ".join(
    f"SELECT category, '{r}' AS rule, CAST(count(*) FILTER (WHERE {r}) AS BIGINT) AS detected, "
    "CAST(count(*) AS BIGINT) AS total FROM cat GROUP BY category" for r in MATRIX_RULES) + """)
  SELECT category, rule, detected, total, detected / total AS rate, """ + _WILSON + """ AS wilson_lb FROM m""",
       rounded=("wilson_lb",))
def agg_rule_matrix(spark, sf):
    return A.rule_matrix(distinct_episodes(spark, sf), MATRIX_RULES)


@query("agg_wilson", f"""WITH {V.PRED}, t AS (SELECT actor, component, CAST(count(*) AS BIGINT) AS total,
    CAST(sum(label) AS BIGINT) AS detected FROM pred GROUP BY 1, 2)
  SELECT actor, component, detected, total, round({_WILSON}, 9) AS wilson_lb FROM t""")
def agg_wilson(spark, sf):
    from tracewell.functions.scalars import wilson_lb
    t = V.predictions(spark, sf).groupBy("actor", "component").agg(
        F.count(F.lit(1)).alias("total"), F.sum(F.col("label").cast("bigint")).alias("detected"))
    return t.withColumn("wilson_lb", F.round(wilson_lb(F.col("detected"), F.col("total")), 9))


@query("agg_bootstrap_ci", f"""WITH {EPISODES} SELECT CASE WHEN label = 1 THEN 'recall' ELSE 'fpr' END AS metric,
  CAST(count(*) FILTER (WHERE fired >= 2) AS BIGINT) AS hits, CAST(count(*) AS BIGINT) AS total,
  CAST(2000 AS BIGINT) AS resamples, true AS holds_rate, true AS near_normal FROM eps GROUP BY 1""")
def agg_bootstrap_ci(spark, sf):
    """The interval holds the rate and is about as wide as the normal one."""
    eps = A.hysteresis(A.episodes(scored_windows(spark, sf)))
    groups = eps.groupBy(F.when(F.col("label") == 1, "recall").otherwise("fpr").alias("metric")).agg(
        F.count_if("alert").alias("hits"), F.count(F.lit(1)).alias("total"))
    rate, width = F.col("hits") / F.col("total"), F.col("high") - F.col("low")
    normal = 2 * 1.96 * F.sqrt(rate * (1 - rate) / F.col("total"))
    ci = A.bootstrap_ci(groups, "metric", "hits", "total", resamples=2000)
    return groups.join(ci, "metric").select(
        "metric", "hits", "total", "resamples", rate.between(F.col("low"), F.col("high")).alias("holds_rate"),
        (F.abs(width - normal) <= 0.2 * normal + 2 / F.col("total")).alias("near_normal"))


_PROFILE = ["n_delete", "n_create", "n_secrets", "has_impersonation", "severity", "n_distinct_verb"]


@query("agg_feature_profile", f"""WITH {Q.LABELLED} SELECT tool, CAST(count(*) AS BIGINT) AS rows, """
       + ", ".join(f"avg({f}) AS {f}_mean, CAST(min({f}) AS DOUBLE) AS {f}_min, "
                   f"CAST(max({f}) AS DOUBLE) AS {f}_max" for f in _PROFILE)
       + ", quantile_cont(prob, 0.5) AS prob_median, quantile_cont(prob, 0.95) AS prob_p95 "
         "FROM lab1 WHERE prob >= 0.3 GROUP BY tool",
       rounded=("prob_median", "prob_p95"))
def agg_feature_profile(spark, sf):
    fired = scored_windows(spark, sf).where(F.col("prob") >= 0.3)
    q = A.score_quantile(fired, {"prob_median": 0.5, "prob_p95": 0.95}, ["tool"])
    return A.feature_profile(fired, "tool", _PROFILE).join(q, "tool")


@query("agg_component_delta", f"""WITH {RULE_SQL}, c AS (SELECT *, {Q.CATEGORY} AS category FROM ep),
  d AS (SELECT category, CAST(count(*) AS BIGINT) AS episodes,
    CAST(count(*) FILTER (WHERE fired >= 1) AS BIGINT) AS model_k1,
    CAST(count(*) FILTER (WHERE fired >= 2) AS BIGINT) AS model_k2,
    CAST(count(*) FILTER (WHERE fired >= 2 OR rule_f) AS BIGINT) AS plus_f,
    CAST(count(*) FILTER (WHERE fired >= 2 OR rule_recon) AS BIGINT) AS plus_recon,
    CAST(count(*) FILTER (WHERE fired >= 2 OR rule_f OR rule_recon) AS BIGINT) AS "full"
    FROM c WHERE category IS NOT NULL GROUP BY category)
  SELECT *, 100.0 * ("full" - model_k2) / episodes AS gain_points FROM d""")
def agg_component_delta(spark, sf):
    eps = with_category(rule_episodes(spark, sf)).where(F.col("category").isNotNull())
    return A.component_delta(eps)


@query("agg_fp_by_identity", f"""WITH {Q.LABELLED}, e AS (SELECT session, actor,
    count(*) FILTER (WHERE prob >= 0.5) AS fired, count(*) AS w,
    count(*) FILTER (WHERE prob >= 0.5 AND n_delete >= 3) AS fd,
    count(*) FILTER (WHERE n_delete >= 3) AS d FROM lab1 WHERE label = 0 GROUP BY 1, 2)
  SELECT actor AS "user", CAST(count(*) FILTER (WHERE fired >= 2) AS BIGINT) AS fp_episodes,
    CAST(count(*) AS BIGINT) AS episodes, CAST(sum(fired) AS BIGINT) AS fp_windows,
    CAST(sum(w) AS BIGINT) AS windows, CAST(sum(fd) AS BIGINT) AS fp_delete_windows,
    CAST(sum(d) AS BIGINT) AS delete_windows FROM e GROUP BY actor""")
def agg_fp_by_identity(spark, sf):
    return A.false_positives(scored_windows(spark, sf))


@query("agg_band_overlap", f"""WITH {Q.LABELLED}, c AS (SELECT
    CAST(count(*) FILTER (WHERE n_selfreview BETWEEN 6 AND 15 AND contains(actor, 'recon-sa')) AS BIGINT)
      AS recon_in_band,
    CAST(count(*) FILTER (WHERE n_selfreview BETWEEN 6 AND 15 AND label = 0) AS BIGINT) AS benign_in_band,
    CAST(count(*) FILTER (WHERE contains(actor, 'recon-sa')) AS BIGINT) AS recon,
    CAST(count(*) FILTER (WHERE label = 0 AND n_selfreview >= 1) AS BIGINT) AS benign_reviews FROM lab1)
  SELECT *, recon_in_band > 0 AND benign_in_band > 0 AS overlap FROM c""")
def agg_band_overlap(spark, sf):
    return A.band_overlap(scored_windows(spark, sf))


@query("agg_window_eval", f"""WITH {V.PRED} SELECT actor, CAST(count(*) AS BIGINT) AS windows,
  CAST(count(*) FILTER (WHERE prob >= 0.5) AS BIGINT) AS flagged, min(prob) AS min_prob,
  avg(prob) AS mean_prob, max(prob) AS max_prob FROM pred GROUP BY actor""",
       rounded=("mean_prob",))
def agg_window_eval(spark, sf):
    return A.window_eval(V.predictions(spark, sf))


@query("agg_unknown_tokens", f"""WITH {TOKENS}, x AS (SELECT DISTINCT audit_id, UNNEST(tokens) AS token
    FROM tk), vocab AS (SELECT DISTINCT concat(verb, ':', resource, ':', sub) AS token FROM audit
    WHERE decision = 'allow')
  SELECT token, CAST(count(*) AS BIGINT) AS windows FROM x
  WHERE token NOT IN (SELECT token FROM vocab) GROUP BY token""")
def agg_unknown_tokens(spark, sf):
    a = V.audit(spark, sf)
    vocab = a.where(F.col("decision") == "allow").select(W.token_column().alias("token")).distinct()
    return A.unknown_tokens(W.token_windows(a), vocab)


@query("agg_diversity", f"""WITH {Q.LABELLED}, v AS (SELECT DISTINCT label, ROW({_VECS}) AS v FROM lab1),
  d AS (SELECT label, CAST(count(*) AS BIGINT) AS distinct_vectors FROM v GROUP BY label),
  n AS (SELECT label, CAST(count(*) AS BIGINT) AS windows FROM lab1 GROUP BY label)
  SELECT label, distinct_vectors, windows, distinct_vectors / windows AS diversity
  FROM d JOIN n USING (label)""")
def agg_diversity(spark, sf):
    return A.diversity(scored_windows(spark, sf), K.EVAL_FEATURES)


@query("join_novel_anti", f"""WITH {RULE_SQL} SELECT audit_id, part FROM lab
  WHERE novel AND part NOT IN ('train', 'drop')""")
def join_novel_anti(spark, sf):
    df = scored_table(spark, sf)
    train = df.where(F.col("part") == "train")
    ev = df.where(~F.col("part").isin("train", "drop"))
    return novel_anti(ev, train, K.EVAL_FEATURES).select("audit_id", "part")
