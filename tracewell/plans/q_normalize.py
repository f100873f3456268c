"""Queries of the projections, filters and normalisation steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell import schemas
from tracewell.functions import constants as K
from tracewell.functions.scalars import severity_band
from tracewell.operators import flow as FL
from tracewell.operators import normalize as N
from tracewell.operators import windows as W
from tracewell.plans import sqltext as Q
from tracewell.plans import views as V
from tracewell.plans.q_sources import labelled_features
from tracewell.plans.registry import query
from tracewell.sources import readers as R


def parsed_events(spark, sf):
    df = R.parse_json_lines(V.audit_lines(spark, sf), "log_s", schemas.AUDIT_EVENT)
    return df.where(~F.col("_bad"))


GOOD = "FROM lines WHERE NOT broken AND NOT blank"


@query("op_flatten_event", f"""WITH {V.LINES} SELECT audit_id AS seq, CAST(copy AS INT) AS copy,
  json_id AS audit_key, actor, verb, resource, sub, ns, code, decision, imp, is_imp {GOOD}""")
def op_flatten_event(spark, sf):
    df = N.flatten_event(parsed_events(spark, sf))
    return df.select("seq", "copy", "audit_key", "actor", "verb", "resource", "sub", "ns", "code",
                     "decision", "imp", "is_imp")


@query("op_flatten_wide", f"""WITH {V.LINES} SELECT audit_id AS seq, CAST(copy AS INT) AS copy,
  us, verb, actor AS "user", concat('g', CAST(k % 3 AS VARCHAR), '|all') AS user_groups,
  'ResponseComplete' AS stage, resource, sub AS subresource, ns AS namespace,
  concat('n', CAST(k AS VARCHAR)) AS name, concat('g', CAST(k % 2 AS VARCHAR)) AS api_group,
  CAST(code AS VARCHAR) AS response_code, source_ip, 'kubectl' AS user_agent,
  concat('/api/', resource) AS request_uri {GOOD}""")
def op_flatten_wide(spark, sf):
    df = N.parse_time(N.flatten_wide(parsed_events(spark, sf)), "timestamp", "at")
    return df.select(
        "seq", "copy", F.unix_micros("at").alias("us"), "verb", "user", "user_groups", "stage",
        "resource", "subresource", "namespace", "name", "api_group", "response_code", "source_ip",
        "user_agent", "request_uri")


def bodies(spark, sf):
    return parsed_events(spark, sf).select(
        "seq", "copy", F.col("event.requestObject").alias("request_object"))


@query("op_pod_flags", f"""WITH {V.LINES} SELECT audit_id AS seq, CAST(copy AS INT) AS copy,
  CAST(k % 3 = 0 AND k % 7 = 0 AS INT) AS pod_privileged,
  CAST(k % 3 = 0 AND k % 4 = 0 AS INT) AS pod_host_path,
  CAST(k % 3 = 0 AND k % 2 = 0 AS INT) AS pod_host_pid,
  CAST(k % 3 = 0 AND k % 5 = 0 AS INT) AS pod_host_network, CAST(0 AS INT) AS pod_host_ipc {GOOD}""")
def op_pod_flags(spark, sf):
    return N.pod_flags(bodies(spark, sf)).drop("request_object")


@query("op_rbac_wildcard", f"""WITH {V.LINES} SELECT audit_id AS seq, CAST(copy AS INT) AS copy,
  CAST(k % 3 = 1 AND k % 2 = 0 AND k % 5 = 0 AS INT) AS rbac_wildcard {GOOD}""")
def op_rbac_wildcard(spark, sf):
    return N.rbac_wildcard(bodies(spark, sf)).drop("request_object")


@query("op_actor_real", f"""WITH {V.AUDIT}, t AS (SELECT audit_id, imp,
    CASE WHEN k % 9 = 0 THEN '' WHEN k % 51 = 0 THEN imp ELSE actor END AS u FROM audit)
  SELECT audit_id, CASE WHEN u <> '' THEN u ELSE imp END AS actor,
    CAST(imp <> '' AND imp <> u AS INT) AS is_imp,
    CASE WHEN imp <> '' AND imp <> u THEN imp ELSE '' END AS imp FROM t""")
def op_actor_real(spark, sf):
    return N.flatten_event(_two_names(spark, sf)).select("audit_id", "actor", "is_imp", "imp")


def _two_names(spark, sf):
    a = V.audit(spark, sf)
    user = F.when(F.col("k") % 9 == 0, "").when(F.col("k") % 51 == 0, F.col("imp")).otherwise(
        F.col("actor"))
    none = lambda t: F.lit(None).cast(t)
    return a.select("audit_id", F.struct(
        none("string").alias("auditID"), none("string").alias("verb"),
        F.struct(user.alias("username")).alias("user"),
        F.struct(F.col("imp").alias("username")).alias("impersonatedUser"),
        F.struct(*[none("string").alias(n) for n in ("resource", "subresource", "namespace")])
        .alias("objectRef"),
        F.struct(none("int").alias("code")).alias("responseStatus"),
        none("map<string,string>").alias("annotations")).alias("event"))


@query("op_actor_effective", f"""WITH {V.AUDIT} SELECT audit_id,
  CASE WHEN imp <> '' THEN imp WHEN k % 9 = 0 THEN '' ELSE actor END AS actor FROM audit""")
def op_actor_effective(spark, sf):
    return N.flatten_event(_two_names(spark, sf), actor_mode="effective").select(
        "audit_id", "actor")


@query("op_drop_system", f"""WITH {V.AUDIT} SELECT audit_id, actor FROM audit
  WHERE actor <> '' AND NOT starts_with(actor, 'system:')""")
def op_drop_system(spark, sf):
    return N.drop_system(V.audit(spark, sf)).select("audit_id", "actor")


@query("op_after_run_start", f"""WITH {V.AUDIT} SELECT
  CAST(count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-10') AS BIGINT) AS kept,
  CAST(count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-10') AS BIGINT) AS skipped_old FROM audit""")
def op_after_run_start(spark, sf):
    return N.run_start_counts(V.audit(spark, sf), F.lit("2024-01-10").cast("timestamp"))


@query("op_dedup_id", f"""WITH {V.LINES}, r AS (SELECT *, row_number() OVER (
    PARTITION BY json_id ORDER BY us, audit_id, copy) AS rn FROM lines
    WHERE NOT broken AND NOT blank)
  SELECT audit_id AS seq, CAST(copy AS INT) AS copy, json_id AS audit_key FROM r
  WHERE json_id = '' OR rn = 1""")
def op_dedup_id(spark, sf):
    df = N.flatten_event(parsed_events(spark, sf)).select("us", "seq", "copy", "audit_key")
    return N.dedup_id(df, "audit_key", ["us", "seq", "copy"]).select("seq", "copy", "audit_key")


@query("op_tool_label", f"WITH {V.AUDIT} SELECT audit_id, {Q.TOOL} AS tool FROM audit")
def op_tool_label(spark, sf):
    return V.audit(spark, sf).select("audit_id", N.tool_label(F.col("actor")).alias("tool"))


@query("op_attack_label", f"""WITH {V.AUDIT}, t AS (SELECT *, {Q.TOOL} AS tool FROM audit)
  SELECT audit_id, CAST(tool IN ({Q.names(K.ATTACK_TOOLS)}) OR {Q.SYN} AS INT) AS label FROM t""")
def op_attack_label(spark, sf):
    return V.audit(spark, sf).select("audit_id", F.when(N.is_attack(F.col("actor")), 1).otherwise(
        0).alias("label"))


@query("op_actor_profile", f"""WITH {V.AUDIT} SELECT audit_id, CASE
  WHEN contains(actor, 'victim-sa') THEN 'stolen-token' WHEN contains(actor, 'recon-sa') THEN 'recon'
  WHEN actor = 'adversary-external' THEN 'valid-abuse'
  WHEN actor = 'adversary-insider' THEN 'low-and-slow' ELSE 'none' END AS profile FROM audit""")
def op_actor_profile(spark, sf):
    return V.audit(spark, sf).select(
        "audit_id", F.coalesce(N.actor_profile(F.col("actor")), F.lit("none")).alias("profile"))


@query("op_identity_flags", f"""WITH {V.AUDIT} SELECT audit_id,
  CAST(starts_with(actor, 'system:') AS INT) AS is_system_user,
  CAST(starts_with(actor, 'system:serviceaccount:') AS INT) AS is_service_account FROM audit""")
def op_identity_flags(spark, sf):
    return V.audit(spark, sf).select(
        "audit_id", *[c.alias(n) for n, c in N.identity_flags(F.col("actor")).items()])


CODE_TEXT = """CASE k % 6 WHEN 0 THEN '' WHEN 1 THEN 'abc' WHEN 2 THEN '201' WHEN 3 THEN '403'
 WHEN 4 THEN '404' ELSE '503' END"""


@query("op_response_flags", f"""WITH {V.AUDIT}, t AS (SELECT audit_id,
    coalesce(TRY_CAST({CODE_TEXT} AS INT), 0) AS c FROM audit)
  SELECT audit_id, CAST(c >= 200 AND c < 300 AS INT) AS resp_2xx,
    CAST(c >= 400 AND c < 500 AS INT) AS resp_4xx, CAST(c = 403 AS INT) AS resp_403,
    CAST(c >= 500 AS INT) AS resp_5xx FROM t""")
def op_response_flags(spark, sf):
    return V.audit(spark, sf).select("audit_id", *[
        c.alias(n) for n, c in N.response_flags(F.expr(CODE_TEXT)).items()])


@query("op_tabular_features", f"""WITH {V.AUDIT}, v AS (SELECT verb, row_number() OVER (
    ORDER BY count(*) DESC, verb) AS rn FROM audit GROUP BY verb)
  SELECT audit_id, actor, CAST(verb = 'create' AS INT) AS verb_create,
    CAST(verb NOT IN (SELECT verb FROM v WHERE rn <= 3) AS INT) AS verb_other,
    CAST(starts_with(actor, 'system:') AS INT) AS is_system_user, CAST(code = 403 AS INT) AS resp_403,
    coalesce((us - lag(us) OVER (PARTITION BY actor ORDER BY us, audit_id)) / 1e6, -1.0)
      AS user_secs_since_prev FROM audit""")
def op_tabular_features(spark, sf):
    a = V.audit(spark, sf).withColumnRenamed("ns", "namespace")
    df = N.tabular_features(a, {"verb": 3, "resource": 25, "namespace": 8})
    return df.select("audit_id", "actor", F.col("`verb=create`").alias("verb_create"),
                     F.col("`verb=other`").alias("verb_other"), "is_system_user", "resp_403",
                     "user_secs_since_prev")


@query("op_scope_filter", f"""WITH {Q.LABELLED} SELECT audit_id, tool FROM lab1 WHERE NOT recon
  AND NOT (tool IN ({Q.names(K.OUT_OF_SCOPE_TOOLS)}) AND label = 1)""")
def op_scope_filter(spark, sf):
    return N.in_scope(labelled_features(spark, sf)).select("audit_id", "tool")


@query("op_deletion_positives", f"""WITH {Q.LABELLED} SELECT audit_id FROM lab1
  WHERE NOT (tool = 'impact' AND label = 1 AND NOT (n_delete >= 1 AND n_create = 0))""")
def op_deletion_positives(spark, sf):
    return N.keep_deletion_positives(labelled_features(spark, sf)).select("audit_id")


@query("op_category_label", f"""WITH {Q.LABELLED} SELECT audit_id, coalesce({Q.CATEGORY}, '')
  AS category FROM lab1""")
def op_category_label(spark, sf):
    from tracewell.operators.splits import tool_part
    df = labelled_features(spark, sf)
    df = df.withColumn("part", tool_part(F.col("tool"), F.col("user"), F.col("session")))
    return df.select("audit_id", F.coalesce(N.category_label(
        F.col("part"), F.col("label"), F.col("user")), F.lit("")).alias("category"))


@query("op_uid", f"WITH {V.AUDIT} SELECT audit_id, {Q.UID} AS uid FROM audit")
def op_uid(spark, sf):
    return V.audit(spark, sf).select("audit_id", N.last_segment(F.col("actor")).alias("uid"))


@query("op_allowlist", f"""WITH {V.AUDIT} SELECT audit_id, {Q.ALLOWED} AS allowed,
  contains(actor, 'deployer') OR contains(actor, 'node') AS loose FROM audit""")
def op_allowlist(spark, sf):
    a = F.col("actor")
    return V.audit(spark, sf).select(
        "audit_id", N.allowed(a).alias("allowed"),
        N.allowed_substring(a, ["deployer", "node"]).alias("loose"))


@query("op_token", f"WITH {V.AUDIT} SELECT audit_id, concat(verb, ':', resource, ':', sub) AS token FROM audit")
def op_token(spark, sf):
    return V.audit(spark, sf).select("audit_id", W.token_column().alias("token"))


@query("op_detect_label_col", f"""WITH {V.FLOW} SELECT 'label' AS label_column, label AS value,
  CAST(count(*) AS BIGINT) AS rows FROM flow GROUP BY label""")
def op_detect_label_col(spark, sf):
    df = V.flows(spark, sf)
    col = FL.detect_label_column(df.columns)
    return df.groupBy(F.lit(col).alias("label_column"), F.col(col).alias("value")).agg(
        F.count(F.lit(1)).alias("rows"))


@query("op_label_binary", f"""WITH {V.FLOW} SELECT row_id, CAST(lower(trim(label)) NOT IN
  ({Q.names(K.BENIGN_LABELS)}) AS INT) AS y, CAST(dst_port <> 0 AS INT) AS y_num FROM flow""")
def op_label_binary(spark, sf):
    df = V.flows(spark, sf)
    return df.select("row_id", FL.label_binary(df, "label").alias("y"),
                     FL.label_binary(df, "dst_port").alias("y_num"))


NORM = "regexp_replace(regexp_replace(lower(trim(label)), '[_/]', ' ', 'g'), ' {2,}', ' ', 'g')"


@query("op_label_normalize", f"""WITH {V.FLOW}, t AS (SELECT row_id, {NORM} AS label_text FROM flow)
  SELECT row_id, label_text, CAST(label_text IN ({Q.names(K.BENIGN_LABELS_WIDE)}) AS INT) AS benign
  FROM t WHERE label_text IN ({Q.names(K.BENIGN_LABELS_WIDE)}) OR contains(label_text, 'ddos')
  OR contains(label_text, 'dos') OR contains(label_text, 'flood')""")
def op_label_normalize(spark, sf):
    df = V.flows(spark, sf).withColumn("label_text", FL.label_normalize(F.col("label")))
    return FL.keep_labels(df, "label_text", "ddos").select(
        "row_id", "label_text", FL.is_benign(F.col("label_text")).cast("int").alias("benign"))


@query("op_drop_identifiers", f"""WITH {V.FLOW} SELECT row_id, protocol, duration, packets_count,
  fwd_packets_count, total_bytes, label, source_file FROM flow""")
def op_drop_identifiers(spark, sf):
    df = FL.drop_identifiers(V.flows(spark, sf), ["L_SHIPDATE"], ignore_case=True)
    return df.withColumn("fwd_packets_count", F.col("fwd_packets_count").cast("double"))


PROTO = "CASE lower(trim(protocol)) WHEN 'tcp' THEN 6 WHEN 'udp' THEN 17 WHEN 'icmp' THEN 1 ELSE {} END"


@query("op_protocol_code", f"""WITH {V.FLOW} SELECT row_id, CAST({PROTO.format(0)} AS INT) AS mapped,
  CAST({PROTO.format(6)} AS INT) AS scalar_code FROM flow""")
def op_protocol_code(spark, sf):
    p = F.col("protocol")
    return V.flows(spark, sf).select(
        "row_id", F.coalesce(FL.protocol_number(p), F.lit(0)).alias("mapped"),
        FL.protocol_scalar(p).alias("scalar_code"))


DIRTY = """CASE l_linenumber WHEN 1 THEN 'abc' WHEN 2 THEN 'Infinity' WHEN 3 THEN '-Infinity'
 WHEN 4 THEN 'NaN' WHEN 5 THEN '' ELSE CAST(l_quantity AS {}) END"""


@query("op_numeric_clean", f"""SELECT l_orderkey, l_partkey, CASE WHEN l_linenumber <= 5 THEN 0.0
  ELSE l_quantity END AS clean FROM lineitem""")
def op_numeric_clean(spark, sf):
    df = V.table(spark, sf, "lineitem").withColumn("dirty", F.expr(DIRTY.format("STRING")))
    return df.select("l_orderkey", "l_partkey", FL.numeric_clean(F.col("dirty")).alias("clean"))


@query("op_rename_schema", f"""WITH {V.FLOW} SELECT row_id, src_ip, duration,
  packets_count AS fwd_packets_count, label FROM flow""")
def op_rename_schema(spark, sf):
    df = V.flows(spark, sf).select(
        "row_id", F.col("src_ip").alias("Src IP"), F.col("duration").alias("Flow Duration"),
        F.col("packets_count").alias("Total Fwd Packet"), F.col("label").alias("Label"))
    return FL.rename_schema(df)


@query("op_align_features", f"""WITH {V.FLOW} SELECT row_id, total_bytes, 0.0::DOUBLE AS missing_one,
  duration FROM flow""")
def op_align_features(spark, sf):
    return FL.align_features(V.flows(spark, sf), ["total_bytes", "missing_one", "duration"],
                             ["row_id"])


DERIVED = f"""{V.FLOW}, dv AS (SELECT *, CASE WHEN (SELECT max(duration) FROM flow) > 1000
    THEN duration / 1000000.0 ELSE duration END AS duration_s,
  CAST(fwd_packets_count AS DOUBLE) AS tot_fwd_pkts,
  greatest(packets_count - fwd_packets_count, 0) AS tot_bwd_pkts, total_bytes AS tot_bytes FROM flow)"""
MEASURES = ["duration_s", "tot_fwd_pkts", "tot_bwd_pkts", "tot_bytes", "fwd_pkt_len_mean",
            "bwd_pkt_len_mean", "flow_pkts_per_s", "flow_iat_mean_s"]


@query("op_derive_flow", f"""WITH {DERIVED} SELECT row_id, duration_s, tot_fwd_pkts, tot_bwd_pkts,
  tot_bytes, CASE WHEN tot_fwd_pkts > 0 THEN tot_bytes / tot_fwd_pkts ELSE 0 END AS fwd_pkt_len_mean,
  CASE WHEN tot_bwd_pkts > 0 THEN tot_bytes / tot_bwd_pkts ELSE 0 END AS bwd_pkt_len_mean,
  packets_count / CASE WHEN duration_s = 0 THEN 1e-9 ELSE duration_s END AS flow_pkts_per_s,
  duration_s / CASE WHEN packets_count = 0 THEN 1 ELSE packets_count END AS flow_iat_mean_s,
  CAST({PROTO.format(6)} AS INT) AS protocol FROM dv""")
def op_derive_flow(spark, sf):
    return FL.derive_flow(V.flows(spark, sf)).select("row_id", *MEASURES, "protocol")


@query("op_flow_text", f"""WITH {V.FLOW}, t AS (SELECT row_id, src_ip, dst_ip, src_port, dst_port,
    CAST({PROTO.format(6)} AS INT) AS proto, CAST(packets_count AS BIGINT) AS p,
    l_shipdate FROM flow)
  SELECT row_id, concat('Network flow from source IP ', src_ip, ' port ', src_port,
    ' to destination IP ', dst_ip, ' port ', dst_port, ' using ',
    CASE proto WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' WHEN 1 THEN 'ICMP' END,
    '. The flow lasted ', p, ' seconds and contained ', p, ' forward packets and ', p,
    ' backward packets with ', p, ' total bytes. Average forward packet length was ', p,
    ', and average backward packet length was ', p, '. The packet rate was ', p,
    ' packets per second, and the mean inter-arrival time was ', p, ' seconds.',
    CASE WHEN starts_with(src_ip, '10.244.') THEN
      ' Kubernetes context: source is a Kubernetes pod.'
    ELSE ' No Kubernetes pod or service context was detected.' END) AS text FROM t""")
def op_flow_text(spark, sf):
    # Whole numbers stand in for the measures: engines print fractions differently.
    whole = F.col("packets_count").cast("bigint")
    df = FL.derive_flow(V.flows(spark, sf)).withColumns({m: whole for m in MEASURES})
    df = df.withColumn("src_is_pod", F.col("src_ip").startswith("10.244."))
    return df.select("row_id", FL.flow_text().alias("text"))


@query("op_audit_text", f"""WITH {V.AUDIT} SELECT audit_id, concat('Kubernetes API audit event where user ',
  actor, ' performed action ', verb, ' on resource ', resource, ' in namespace ', ns,
  ' from source IP ', source_ip, '. The API server returned response code ', code, '.') AS text
  FROM audit""")
def op_audit_text(spark, sf):
    a = V.audit(spark, sf).withColumnsRenamed(
        {"actor": "user", "ns": "namespace", "code": "response_code"})
    return a.select("audit_id", N.audit_text().alias("text"))


@query("op_packet_flags", f"""WITH {V.FLOW}, t AS (SELECT row_id, src_ip, dst_ip,
    CAST(dst_port % 64 AS INT) AS flags, CASE WHEN {PROTO.format(6)} = 1 THEN 17 ELSE
    {PROTO.format(6)} END AS proto,
    string_split(src_ip, '.') AS s, string_split(dst_ip, '.') AS d FROM flow)
  SELECT row_id, CAST(proto = 6 AND flags & 1 <> 0 AS INT) AS fin,
    CAST(proto = 6 AND flags & 2 <> 0 AS INT) AS syn, CAST(proto = 6 AND flags & 4 <> 0 AS INT) AS rst,
    CAST(proto = 6 AND flags & 8 <> 0 AS INT) AS psh, CAST(proto = 6 AND flags & 16 <> 0 AS INT) AS ack,
    CAST(proto = 6 AND flags & 32 <> 0 AS INT) AS urg,
    CAST(s[1] = '10' AND s[2] = '244' AS INT) AS src_is_pod,
    CAST(d[1] = '10' AND d[2] = '244' AS INT) AS dst_is_pod,
    CAST(d[1] = '10' AND CAST(d[2] AS INT) BETWEEN 96 AND 111 AS INT) AS dst_is_service FROM t""")
def op_packet_flags(spark, sf):
    code = FL.protocol_scalar(F.col("protocol"))
    df = V.flows(spark, sf).withColumns({
        "flags": (F.col("dst_port") % 64).cast("int"),
        "proto": F.when(code == 1, 17).otherwise(code)})
    out = FL.packet_flags(df)
    return out.select("row_id", *K.TCP_FLAG_BITS, "src_is_pod", "dst_is_pod", "dst_is_service")


@query("op_encode_unknown", f"""WITH {V.FLOW}, c AS (SELECT dst_ip, row_number() OVER (ORDER BY dst_ip) - 1
    AS code FROM (SELECT DISTINCT dst_ip FROM flow WHERE source_file <= 'day2.csv'))
  SELECT row_id, CAST(coalesce(code, -1) AS BIGINT) AS code FROM flow LEFT JOIN c USING (dst_ip)""")
def op_encode_unknown(spark, sf):
    from tracewell.operators.splits import encode_category
    df = V.flows(spark, sf)
    seen = df.where(F.col("source_file") <= "day2.csv")
    return encode_category(df.select("row_id", "dst_ip"), seen, "dst_ip").select(
        "row_id", F.col("code").cast("bigint").alias("code"))


@query("op_severity_band", f"""WITH {V.PRED} SELECT row_id, CASE WHEN prob >= 0.95 THEN 'CRITICAL'
  WHEN prob >= 0.85 THEN 'HIGH' WHEN prob >= 0.70 THEN 'MEDIUM' WHEN prob >= 0.50 THEN 'LOW'
  ELSE 'NONE' END AS severity FROM pred""")
def op_severity_band(spark, sf):
    return V.predictions(spark, sf).select("row_id", severity_band(F.col("prob")).alias("severity"))
