"""Queries of the joins, top-k, set operations, samples and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import constants as K
from tracewell.operators import flow as FL
from tracewell.operators import joins as J
from tracewell.operators import normalize as N
from tracewell.operators import splits as SP
from tracewell.operators import windows as W
from tracewell.operators.evaluate import score_points
from tracewell.plans import sqltext as Q
from tracewell.plans import views as V
from tracewell.plans.q_windows import _VECS, TOKENS, scored_table, scored_windows, token_table
from tracewell.plans.registry import query

DAY = 86_400_000_000
HALF = DAY // 2


def spans(spark, sf):
    """Two overlapping spans per calendar day of the events; ids repeat every ten days."""
    day = V.audit(spark, sf).select(F.floor(F.col("us") / DAY).alias("d")).distinct()
    shift = F.explode(F.array(F.lit(0), F.lit(1))).alias("h")
    return day.select("d", shift).select(
        (F.col("d") % 10 * 2 + F.col("h")).cast("bigint").alias("session"),
        (F.col("d") * DAY + F.col("h") * (HALF // 2)).alias("start_us"),
        (F.col("d") * DAY + F.col("h") * (HALF // 2) + HALF).alias("end_us"),
        (F.col("d") * 2 + F.col("h")).alias("pos"))


SPANS = f"""spans AS (SELECT DISTINCT CAST(us // {DAY} % 10 * 2 + h AS BIGINT) AS session,
    us // {DAY} * {DAY} + h * {HALF // 2} AS start_us,
    us // {DAY} * {DAY} + h * {HALF // 2} + {HALF} AS end_us, us // {DAY} * 2 + h AS pos
    FROM audit, UNNEST([0, 1]) AS u(h))"""


@query("join_session_span", f"""WITH {V.AUDIT}, {SPANS}, m AS (SELECT audit_id, s.session, row_number()
    OVER (PARTITION BY audit_id ORDER BY pos) AS rn FROM audit a JOIN spans s
    ON a.us BETWEEN s.start_us AND s.end_us)
  SELECT audit_id, session AS span_session FROM m WHERE rn = 1""")
def join_session_span(spark, sf):
    return J.session_span(V.audit(spark, sf), spans(spark, sf)).select("audit_id", "span_session")


@query("join_session_span_second", f"""WITH {V.AUDIT}, {SPANS}, m AS (SELECT audit_id, s.session,
    row_number() OVER (PARTITION BY audit_id ORDER BY pos) AS rn FROM audit a JOIN spans s
    ON a.us // 1000000 * 1000000 BETWEEN s.start_us AND s.end_us)
  SELECT audit_id, session AS span_session FROM m WHERE rn = 1""")
def join_session_span_second(spark, sf):
    return J.session_span(V.audit(spark, sf), spans(spark, sf), "second").select(
        "audit_id", "span_session")


@query("join_attack_window", f"""WITH {V.AUDIT}, {SPANS}, m AS (SELECT audit_id,
    concat('type', CAST(s.session % 4 AS VARCHAR)) AS t, row_number()
    OVER (PARTITION BY audit_id ORDER BY pos) AS rn FROM audit a JOIN spans s
    ON a.us BETWEEN s.start_us AND s.end_us WHERE NOT starts_with(actor, 'system:'))
  SELECT a.audit_id, CAST(t IS NOT NULL AS INT) AS window_label, coalesce(t, '') AS window_type
  FROM audit a LEFT JOIN (SELECT * FROM m WHERE rn = 1) m ON a.audit_id = m.audit_id""")
def join_attack_window(spark, sf):
    win = spans(spark, sf).withColumn(
        "attack_type", F.concat(F.lit("type"), (F.col("session") % 4).cast("string")))
    return J.attack_window(V.audit(spark, sf), win).select(
        "audit_id", "window_label", "window_type")


@query("join_causal_relabel", f"""WITH {V.AUDIT} SELECT audit_id, CAST(actor = 'ci-deployer'
  AND ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-15' AS INT) AS label FROM audit""")
def join_causal_relabel(spark, sf):
    at = lambda d: F.lit(d).cast("timestamp")
    return J.causal_relabel(V.audit(spark, sf), F.col("actor") == "ci-deployer",
                            at("2024-01-10"), at("2024-01-15")).select("audit_id", "label")


@query("join_pod_actor", f"""WITH {V.AUDIT}, p AS (SELECT audit_id, CASE WHEN k % 4 = 0 THEN ''
    ELSE concat('pod-', CAST(user_id % 12 AS VARCHAR)) END AS pod FROM audit),
  m AS (SELECT concat('pod-', CAST(user_id % 12 AS VARCHAR)) AS pod, min(actor) AS actor FROM audit
    WHERE contains(actor, 'rakkess') GROUP BY 1)
  SELECT audit_id, coalesce(m.actor, CASE WHEN p.pod <> '' THEN concat('pod:', p.pod) ELSE 'unknown' END)
    AS actor FROM p LEFT JOIN m ON p.pod = m.pod""")
def join_pod_actor(spark, sf):
    a = V.audit(spark, sf)
    pod = F.concat(F.lit("pod-"), (F.col("user_id") % 12).cast("string"))
    mapping = a.where(F.col("actor").contains("rakkess")).groupBy(pod.alias("pod")).agg(
        F.min("actor").alias("actor"))
    rows = a.select("audit_id", F.when(F.col("k") % 4 == 0, "").otherwise(pod).alias("pod"))
    return J.pod_actor(rows, mapping).select("audit_id", "actor")


@query("join_known_allow", f"""WITH {Q.LABELLED} SELECT DISTINCT actor AS "user" FROM lab1
  WHERE label = 0 AND allowed""")
def join_known_allow(spark, sf):
    return J.known_allow(scored_windows(spark, sf))


HELD = f"part IN ({Q.names(K.HELD_OUT_PARTS)})"
LEAK = f"""{Q.LABELLED}, bad AS (SELECT DISTINCT ROW({_VECS}) AS v FROM lab1 WHERE label = 1 AND {HELD})"""


@query("join_leak_anti", f"""WITH {LEAK} SELECT audit_id, label FROM lab1 WHERE part = 'train'
  AND (label <> 1 OR ROW({_VECS}) NOT IN (SELECT v FROM bad))""")
def join_leak_anti(spark, sf):
    df = scored_table(spark, sf)
    train = df.where(F.col("part") == "train")
    held = df.where(F.col("part").isin(K.HELD_OUT_PARTS))
    return J.leak_anti(train, held, K.EVAL_FEATURES).select("audit_id", "label")


@query("join_overlap_rate", f"""WITH {Q.LABELLED}, tr AS (SELECT DISTINCT ROW({_VECS}) AS v FROM lab1
    WHERE part = 'train'), te AS (SELECT ROW({_VECS}) AS v FROM lab1 WHERE part = 'test'),
  c AS (SELECT CAST(count(*) AS BIGINT) AS test_rows,
    CAST(count(*) FILTER (WHERE v IN (SELECT v FROM tr)) AS BIGINT) AS dup_rows FROM te)
  SELECT *, dup_rows / test_rows AS dup_rate FROM c""")
def join_overlap_rate(spark, sf):
    df = scored_table(spark, sf)
    return J.overlap_rate(df.where(F.col("part") == "test"), df.where(F.col("part") == "train"),
                          K.EVAL_FEATURES)


FLAB = f"""{V.FLOW}, fl AS (SELECT *, CAST(lower(trim(label)) NOT IN ({Q.names(K.BENIGN_LABELS)}) AS INT)
    AS y FROM flow), top3 AS (SELECT src_ip, CAST(count(*) AS BIGINT) AS attacks FROM fl WHERE y = 1
    GROUP BY src_ip ORDER BY attacks DESC, src_ip LIMIT 3)"""


def labelled_flows(spark, sf):
    df = V.flows(spark, sf)
    return df.withColumn("label", FL.label_binary(df, "label"))


@query("join_heavy_hitter", f"""WITH {FLAB} SELECT row_id, src_ip,
  CAST(src_ip IN (SELECT src_ip FROM top3) AS INT) AS is_heavy FROM fl""")
def join_heavy_hitter(spark, sf):
    df = labelled_flows(spark, sf)
    return J.heavy_hitter(df, SP.topk_sources(df, 3)).select("row_id", "src_ip", "is_heavy")


@query("op_topk_sources", f"""WITH {FLAB} SELECT src_ip, attacks,
  attacks / (SELECT sum(y) FROM fl) AS share FROM top3""")
def op_topk_sources(spark, sf):
    return SP.topk_sources(labelled_flows(spark, sf), 3)


@query("join_positional", f"""WITH {V.PRED}, b AS (SELECT row_id, CASE WHEN attack_type = 'discovery'
    AND prob >= 0.7 THEN 1 - label ELSE label END AS label FROM pred
    WHERE component <> 'c2' OR prob < 0.75)
  SELECT CAST(count(*) FILTER (WHERE b.row_id IS NOT NULL) AS BIGINT) AS matched,
    CAST(count(*) FILTER (WHERE b.row_id IS NULL) AS BIGINT) AS left_only,
    CAST(0 AS BIGINT) AS right_only,
    CAST(count(*) FILTER (WHERE b.label <> p.label) AS BIGINT) AS label_conflicts
  FROM pred p LEFT JOIN b ON p.row_id = b.row_id""")
def join_positional(spark, sf):
    p = V.predictions(spark, sf)
    flip = (F.col("attack_type") == "discovery") & (F.col("prob") >= 0.7)
    other = p.where((F.col("component") != "c2") | (F.col("prob") < 0.75)).withColumn(
        "label", F.when(flip, 1 - F.col("label")).otherwise(F.col("label")))
    return J.alignment_report(p, other)


def known_attackers():
    """Rows that make their actor an attacker in the set queries."""
    return ((F.col("label") == 1) & (F.col("attack_type") == "discovery") & (F.col("prob") >= 0.8))


@query("join_actor_sets", f"""WITH {V.PRED}, t AS (SELECT DISTINCT actor FROM pred WHERE label = 1 AND attack_type = 'discovery' AND prob >= 0.8),
  f AS (SELECT DISTINCT actor FROM pred WHERE prob >= 0.85),
  c AS (SELECT CAST(count(*) FILTER (WHERE t.actor IS NOT NULL AND f.actor IS NOT NULL) AS BIGINT) AS tp,
    CAST(count(*) FILTER (WHERE t.actor IS NULL) AS BIGINT) AS fp,
    CAST(count(*) FILTER (WHERE f.actor IS NULL) AS BIGINT) AS fn
    FROM t FULL JOIN f ON t.actor = f.actor)
  SELECT *, round_even(tp / greatest(tp + fp, 1), 4) AS precision,
    round_even(tp / greatest(tp + fn, 1), 4) AS recall FROM c""")
def join_actor_sets(spark, sf):
    p = V.predictions(spark, sf)
    return J.actor_sets(p.where(known_attackers()),
                        p.where(F.col("prob") >= 0.85))


@query("join_two_planes", f"""WITH {V.PRED} SELECT row_id AS seq, actor, 'audit' AS plane, NULL AS pod
    FROM pred WHERE component <> 'c2' UNION ALL
  SELECT row_id, actor, 'syscall', component FROM pred WHERE component = 'c2'""")
def join_two_planes(spark, sf):
    p = V.predictions(spark, sf).withColumnRenamed("row_id", "seq")
    a = p.where(F.col("component") != "c2").select("seq", "actor", F.lit("audit").alias("plane"))
    b = p.where(F.col("component") == "c2").select(
        "seq", "actor", F.lit("syscall").alias("plane"), F.col("component").alias("pod"))
    return J.two_planes(a, b)


# ---- sort, top-k, vocabularies, sets --------------------------------------------------------

@query("op_sort_time", f"""WITH {V.AUDIT} SELECT audit_id, us, row_number() OVER (ORDER BY us, audit_id) - 1
  AS place FROM audit""")
def op_sort_time(spark, sf):
    """The rows with the place at which the sorted table holds them."""
    from tracewell.operators.partition import range_totals
    from tracewell.session import written_table
    rows = written_table(N.time_order(V.audit(spark, sf).select("audit_id", "us"), ["us", "audit_id"])
                         .withColumn("part", F.spark_partition_id())
                         .withColumn("n", F.monotonically_increasing_id()), "sorted")
    return range_totals(rows, [F.col("part"), F.col("n")], {"place": F.lit(1)}).select(
        "audit_id", "us", (F.col("place") - 1).alias("place"))


@query("op_onehot_topk", f"""WITH {V.AUDIT}, v AS (SELECT ns, row_number() OVER (ORDER BY count(*) DESC, ns)
    AS rn FROM audit GROUP BY ns), a AS (SELECT audit_id, rn FROM audit JOIN v USING (ns))
  SELECT audit_id, CAST(rn = 1 AS INT) AS top1, CAST(rn = 2 AS INT) AS top2,
    CAST(rn = 3 AS INT) AS top3, CAST(rn > 3 AS INT) AS other FROM a""")
def op_onehot_topk(spark, sf):
    df = N.onehot_topk(V.audit(spark, sf), "ns", 3, ["audit_id"])
    return df.toDF("audit_id", "top1", "top2", "top3", "other")


VOCAB = """vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY token) + 1 AS BIGINT) AS id
    FROM (SELECT DISTINCT concat(verb, ':', resource, ':', sub) AS token FROM audit{where})
    UNION ALL SELECT '<PAD>', 0 UNION ALL SELECT '<UNK>', 1)"""


@query("op_vocab", f"WITH {V.AUDIT}, {VOCAB.format(where='')} SELECT token, id FROM vocab")
def op_vocab(spark, sf):
    return SP.vocabulary(V.audit(spark, sf).select(W.token_column().alias("token")))


@query("op_encode_tokens", f"""WITH {TOKENS}, {VOCAB.format(where=" WHERE decision = 'allow'")},
  p AS (SELECT audit_id, list_concat(list_transform(range(20 - len(tokens)), lambda x: '<PAD>'), tokens) AS l
    FROM tk), e AS (SELECT audit_id, i, l[i] AS token FROM p, UNNEST(range(1, 21)) AS u(i))
  SELECT audit_id, string_agg(CAST(coalesce(id, 1) AS VARCHAR), ' ' ORDER BY i) AS ids
  FROM e LEFT JOIN vocab USING (token) GROUP BY audit_id""")
def op_encode_tokens(spark, sf):
    a = V.audit(spark, sf)
    vocab = SP.vocabulary(a.where(F.col("decision") == "allow").select(W.token_column().alias("token")))
    out = SP.encode_tokens(token_table(spark, sf), vocab, ["audit_id"])
    return out.select("audit_id", F.array_join(F.transform(
        "token_ids", lambda x: x.cast("string")), " ").alias("ids"))


@query("op_dedup_vectors", f"WITH {Q.LABELLED} SELECT DISTINCT label, {Q.vec_cols()} FROM lab1")
def op_dedup_vectors(spark, sf):
    return SP.dedup_vectors(scored_windows(spark, sf), K.EVAL_FEATURES)


@query("op_class_weight", f"""WITH {V.PRED}, c AS (SELECT CAST(count(*) FILTER (WHERE label = 0) AS BIGINT)
    AS negatives, CAST(count(*) FILTER (WHERE label = 1) AS BIGINT) AS positives FROM pred)
  SELECT *, least(greatest(1.0, negatives / greatest(positives, 1)), 11.0) AS weight FROM c""")
def op_class_weight(spark, sf):
    return SP.class_weight(V.predictions(spark, sf))


@query("op_oversample", f"""WITH {V.AUDIT} SELECT audit_id, CAST(copy AS INT) AS copy FROM audit,
  UNNEST(range(1, CASE WHEN actor = 'ci-deployer' THEN 13 ELSE 2 END)) AS u(copy)""")
def op_oversample(spark, sf):
    return SP.oversample(V.audit(spark, sf), F.col("actor") == "ci-deployer", 12).select(
        "audit_id", "copy")


@query("set_union_sources", f"""WITH {V.FLOW} SELECT row_id, src_ip, CAST(NULL AS STRING) AS dst_ip FROM flow
  UNION ALL SELECT row_id, NULL, dst_ip FROM flow""")
def set_union_sources(spark, sf):
    df = V.flows(spark, sf)
    return SP.union_sources(df.select("row_id", "src_ip"), df.select("row_id", "dst_ip"))


@query("set_intersect_diff", f"""WITH {V.PRED}, a AS (SELECT DISTINCT actor FROM pred WHERE label = 1 AND attack_type = 'discovery' AND prob >= 0.8),
  b AS (SELECT DISTINCT actor FROM pred WHERE prob >= 0.85)
  SELECT coalesce(a.actor, b.actor) AS actor, CASE WHEN b.actor IS NULL THEN 'left'
    WHEN a.actor IS NULL THEN 'right' ELSE 'both' END AS side FROM a FULL JOIN b ON a.actor = b.actor""")
def set_intersect_diff(spark, sf):
    p = V.predictions(spark, sf)
    return SP.intersect_diff(p.where(known_attackers()).select("actor"),
                             p.where(F.col("prob") >= 0.85).select("actor"))


# ---- splits and samples ---------------------------------------------------------------------

@query("split_time_fraction", f"""WITH {V.AUDIT}, r AS (SELECT audit_id, actor,
    row_number() OVER (ORDER BY us, audit_id) AS rn, count(*) OVER () AS n,
    row_number() OVER (PARTITION BY actor ORDER BY us, audit_id) AS ra,
    count(*) OVER (PARTITION BY actor) AS na FROM audit)
  SELECT audit_id, CASE WHEN rn <= floor(n * CAST(0.7 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split,
    CASE WHEN ra <= floor(na * CAST(0.7 AS DOUBLE)) THEN 'train' ELSE 'test' END AS actor_split FROM r""")
def split_time_fraction(spark, sf):
    a = V.audit(spark, sf).select("audit_id", "actor", "us")
    whole = SP.time_fraction(a)
    per = SP.time_fraction(a, keys=["actor"]).select(
        "audit_id", F.col("split").alias("actor_split"))
    return whole.join(per, "audit_id").select("audit_id", "split", "actor_split")


@query("split_halves", f"""WITH {V.PRED}, r AS (SELECT row_id, component, row_number() OVER (
    PARTITION BY component ORDER BY row_id) AS rn, count(*) OVER (PARTITION BY component) AS n FROM pred)
  SELECT row_id, component, CASE WHEN rn <= n // 2 THEN 'calibration' ELSE 'evaluation' END AS half
  FROM r""")
def split_halves(spark, sf):
    return SP.halves(V.predictions(spark, sf), keys=["component"]).select(
        "row_id", "component", "half")


@query("split_tool_disjoint", f"""WITH {Q.LABELLED} SELECT audit_id, tool, part FROM lab1""")
def split_tool_disjoint(spark, sf):
    return scored_windows(spark, sf).select("audit_id", "tool", "part")


@query("split_identity", f"""WITH {V.AUDIT}, t AS (SELECT audit_id, {Q.UID} AS uid FROM audit),
  h AS (SELECT uid, row_number() OVER (ORDER BY uid) AS rn FROM (SELECT DISTINCT uid FROM t))
  SELECT audit_id, CASE WHEN rn % 2 = 0 THEN 'train' ELSE 'ho' END AS part FROM t JOIN h USING (uid)""")
def split_identity(spark, sf):
    a = V.audit(spark, sf).select("audit_id", N.last_segment(F.col("actor")).alias("uid"))
    ids = SP.encode_category(a.select("uid").distinct(), a, "uid")
    return SP.identity_split(a, ids.where(F.col("code") % 2 == 1).select(
        "uid", F.lit("train").alias("part"))).select("audit_id", "part")


@query("split_session", f"""WITH {V.AUDIT}, s AS (SELECT session, row_number() OVER (ORDER BY session) AS rn,
    count(*) OVER () AS n FROM (SELECT DISTINCT session FROM audit))
  SELECT audit_id, CASE WHEN rn <= floor(n * CAST(0.7 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split
  FROM audit JOIN s USING (session)""")
def split_session(spark, sf):
    return SP.session_split(V.audit(spark, sf)).select("audit_id", "split")


@query("split_holdout_file", f"""WITH {V.FLOW}, f AS (SELECT source_file, row_number() OVER (
    ORDER BY source_file) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT source_file FROM flow))
  SELECT row_id, CASE WHEN rn <= floor(n * CAST(0.7 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split,
    CASE WHEN source_file = 'day3.csv' THEN 'test' ELSE 'train' END AS day_split
  FROM flow JOIN f USING (source_file)""")
def split_holdout_file(spark, sf):
    df = SP.holdout_file(V.flows(spark, sf)).withColumnRenamed("split", "by_order")
    return SP.holdout_file(df, "day3.csv").select(
        "row_id", F.col("by_order").alias("split"), F.col("split").alias("day_split"))


DRAW = "CAST('0x' || substr(md5('{seed}|' || CAST(row_id AS VARCHAR)), 1, 8) AS BIGINT)"
DRAWN = "md5('{seed}|' || CAST(row_id AS VARCHAR))"


@query("split_lho", f"""WITH {FLAB} SELECT row_id, y AS label, CASE WHEN CASE WHEN y = 1
    THEN src_ip IN (SELECT src_ip FROM top3) ELSE {DRAW.format(seed=42)} % 100 < 30 END
  THEN 'test' ELSE 'train' END AS split FROM fl""")
def split_lho(spark, sf):
    return SP.leave_heavy_hitter_out(labelled_flows(spark, sf), 3).select("row_id", "label", "split")


@query("split_stratified", f"""WITH {FLAB}, r AS (SELECT row_id, y, count(*) OVER (PARTITION BY y) AS n,
    row_number() OVER (PARTITION BY y ORDER BY {DRAWN.format(seed=42)}, row_id) AS p FROM fl)
  SELECT row_id, y AS label, CASE WHEN p <= floor(n * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split
  FROM r""")
def split_stratified(spark, sf):
    return SP.stratified_split(labelled_flows(spark, sf)).select("row_id", "label", "split")


@query("sample_stratified", f"""WITH {FLAB}, r AS (SELECT row_id, y, {DRAWN.format(seed=123)} AS h,
    row_number() OVER (PARTITION BY y ORDER BY {DRAWN.format(seed=123)}, row_id) AS p FROM fl)
  SELECT row_id, y AS label FROM r
  ORDER BY CASE WHEN p <= 500 THEN 0 ELSE 1 END, h, row_id LIMIT 1000""")
def sample_stratified(spark, sf):
    return SP.sample_stratified(labelled_flows(spark, sf), 1000).select("row_id", "label")


@query("sample_n", f"""WITH {V.FLOW} SELECT row_id FROM flow ORDER BY {DRAWN.format(seed=42)}, row_id
  LIMIT 1000""")
def sample_n(spark, sf):
    return SP.sample_n(V.flows(spark, sf), 1000).select("row_id")


@query("split_assert_strata", f"""WITH {V.AUDIT}, e AS (SELECT DISTINCT session, actor, CASE
    WHEN contains(actor, 'victim-sa') THEN 'stolen-token' ELSE 'recon' END AS profile FROM audit
    WHERE contains(actor, 'victim-sa') OR contains(actor, 'recon-sa')),
  r AS (SELECT profile, CAST(count(*) FILTER (WHERE session <= 5) AS BIGINT) AS train_episodes,
    CAST(count(*) FILTER (WHERE session > 5) AS BIGINT) AS test_episodes FROM e GROUP BY profile)
  SELECT *, train_episodes > 0 AND test_episodes >= CASE WHEN profile = 'recon' THEN 4 ELSE 1 END
    AS passes FROM r""")
def split_assert_strata(spark, sf):
    a = V.audit(spark, sf).select("session", "actor").distinct()
    eps = SP.session_split(a).withColumn("profile", N.actor_profile(F.col("actor")))
    return SP.strata_report(eps.where(F.col("profile").isNotNull()))


@query("op_topk_by_auc", f"""WITH {V.PRED}, {Q.points_cte('pred', 'component')}
  SELECT component, {Q.AUC} AS roc_auc FROM pts GROUP BY component ORDER BY roc_auc DESC LIMIT 2""")
def op_topk_by_auc(spark, sf):
    """Components ranked by ROC area."""
    from tracewell.operators.evaluate import auc
    pts = score_points(V.predictions(spark, sf), keys=["component"])
    return auc(pts, ["component"]).select("component", "roc_auc").orderBy(
        F.desc("roc_auc"), "component").limit(2)
