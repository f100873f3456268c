"""Audit, prediction, flow and metric views over the given tables.

The column rules are plain SQL that both engines accept; ``us`` is the event time in microseconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# One identity per user, cycling over attack tools, controllers and people.
ACTOR_STEMS = [
    "adversary-escv-", "redteam-stratus-", "system:serviceaccount:kube-system:c", "ci-deployer",
    "redteam-peirates-", "adversary-lat-", "adversary-impv-", "redteam-rakkess-", "ns:recon-sa-",
    "adversary-evav-", "adversary-stealth-", "redteam-persist-", "redteam-lat-ext-",
    "system:node:n", "victim-sa-", "user-", "user-", "user-", "user-", "user-"]
ACTOR = f"""concat(CASE user_id % 20 {' '.join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(ACTOR_STEMS))} END,
 CASE WHEN user_id % 20 = 3 THEN '' ELSE CAST(CASE WHEN user_id % 20 IN (0, 6) THEN user_id % 7
   WHEN user_id % 20 = 5 THEN user_id % 11 WHEN user_id % 20 = 9 THEN user_id % 9
   ELSE user_id END AS STRING) END)"""
K_INT = "CAST(regexp_extract(props, '[0-9]+', 0) AS INT)"
REVIEWER = "(user_id % 20 IN (7, 8) AND k % 4 < 3)"

AUDIT_COLUMNS = {
    "audit_id": "event_id",
    "session": "CAST(1 + FLOOR(us / 86400000000) % 8 AS BIGINT)",
    "actor": ACTOR,
    "verb": f"""CASE WHEN {REVIEWER} THEN 'create' WHEN event_type = 'view' THEN 'get'
      WHEN event_type = 'click' THEN 'list' WHEN event_type = 'signup' THEN 'create'
      WHEN event_type = 'purchase' THEN 'update' ELSE 'delete' END""",
    "resource": f"""CASE WHEN {REVIEWER} THEN 'selfsubjectaccessreviews'
      WHEN k % 8 = 0 THEN 'secrets' WHEN k % 8 = 1 THEN 'pods'
      WHEN k % 8 = 2 THEN 'clusterrolebindings' WHEN k % 8 = 3 THEN 'selfsubjectaccessreviews'
      WHEN k % 8 = 4 THEN 'serviceaccounts' WHEN k % 8 = 5 THEN 'deployments'
      WHEN k % 8 = 6 THEN 'certificatesigningrequests' ELSE 'configmaps' END""",
    "sub": """CASE WHEN k % 8 = 1 AND k % 3 = 0 THEN 'exec'
      WHEN k % 8 = 4 AND k % 2 = 0 THEN 'token' ELSE '' END""",
    "ns": "CASE WHEN k % 5 = 4 THEN '' ELSE concat('ns', CAST(k % 5 AS STRING)) END",
    "code": "CASE WHEN event_type = 'error' THEN 403 ELSE 200 END",
    "decision": "CASE WHEN event_type = 'error' THEN 'forbid' ELSE 'allow' END",
    "imp": "CASE WHEN k % 17 = 0 THEN concat('victim-', CAST(k % 3 AS STRING)) ELSE '' END",
    "is_imp": "CASE WHEN k % 17 = 0 THEN 1 ELSE 0 END",
    "source_ip": "concat('10.', CAST(k % 4 AS STRING), '.0.', CAST(user_id % 9 AS STRING))",
}

HINT = """CASE k % 6 WHEN 0 THEN 'discovery' WHEN 1 THEN 'credential_theft'
 WHEN 2 THEN 'privilege_escalation' WHEN 3 THEN 'container_escape'
 WHEN 4 THEN 'container_exec' ELSE 'token_theft' END"""
PRED_COLUMNS = {
    "row_id": "event_id",
    "actor": "concat('u', CAST(user_id - user_id % 10 AS STRING))",
    "component": "concat('c', CAST(user_id % 3 AS STRING))",
    "prob": "value / (value + 50)",
    "label": "CASE WHEN (value > 40 AND k % 2 = 0) OR k % 13 = 0 THEN 1 ELSE 0 END",
    "attack_type": HINT,
}

FLOW_COLUMNS = {
    "row_id": "l_orderkey * 8 + l_linenumber",
    "src_ip": """concat('10.', CAST(l_suppkey % 3 + 243 AS STRING), '.', CAST(l_suppkey % 16 AS STRING),
      '.', CAST(l_suppkey % 5 AS STRING))""",
    "dst_ip": """concat('10.', CAST(l_partkey % 24 + 90 AS STRING), '.0.',
      CAST(l_partkey % 256 AS STRING))""",
    "src_port": "CAST(1024 + l_orderkey % 5000 AS INT)",
    "dst_port": "CAST(l_partkey % 1000 AS INT)",
    "protocol": """CASE l_linenumber % 4 WHEN 0 THEN 'tcp' WHEN 1 THEN 'UDP '
      WHEN 2 THEN 'icmp' ELSE '' END""",
    "duration": "l_extendedprice",
    "packets_count": "l_quantity",
    "fwd_packets_count": "FLOOR(l_quantity * 0.6)",
    "total_bytes": "l_quantity * 100 + l_linenumber",
    "label": """CASE WHEN l_returnflag = 'A' THEN 'DDoS_HTTP/Flood' WHEN l_returnflag = 'R'
      THEN ' Port  Scan' ELSE 'Benign ' END""",
    "source_file": "concat('day', CAST(l_linenumber AS STRING), '.csv')",
}


def _derive(base: DataFrame, columns: dict[str, str], keep: list[str]) -> DataFrame:
    return base.selectExpr(*keep, *[f"{e} AS {n}" for n, e in columns.items()])


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "events")
            .withColumn("ts", F.col("ts").cast("timestamp"))
            .withColumn("us", F.unix_micros("ts"))
            .withColumn("k", F.expr(K_INT)))


def audit_from(base: DataFrame) -> DataFrame:
    return _derive(base, AUDIT_COLUMNS, ["ts", "us", "k", "user_id", "value"])


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_from(events(spark, sf_dir))


def predictions_from(base: DataFrame) -> DataFrame:
    return _derive(base, PRED_COLUMNS, ["ts", "us", "k"])


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions_from(events(spark, sf_dir))


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(table(spark, sf_dir, "lineitem"), FLOW_COLUMNS, ["l_shipdate"])


def _json_line():
    """An audit event document; repeated blanks of the id and three kinds of request body."""
    k, c = F.col("k"), F.col
    text = lambda x: x.cast("string")
    pod = F.struct(
        (k % 2 == 0).alias("hostPID"), (k % 5 == 0).alias("hostNetwork"),
        F.array(F.struct(F.lit("v").alias("name"), F.when(
            k % 4 == 0, F.struct(F.lit("/").alias("path"))).alias("hostPath"))).alias("volumes"),
        F.array(F.struct(F.lit("c").alias("name"), F.struct(
            (k % 7 == 0).alias("privileged")).alias("securityContext"))).alias("containers"))
    rules = F.array(F.struct(F.array(F.when(k % 5 == 0, "*").otherwise("get")).alias("verbs"),
                             F.array(F.lit("pods")).alias("resources")))
    body = F.when(k % 3 < 2, F.struct(
        F.when(k % 3 == 0, "Pod").when(k % 2 == 0, "ClusterRole").otherwise("Thing").alias("kind"),
        F.when(k % 3 == 0, pod).alias("spec"), F.when(k % 3 == 1, rules).alias("rules")))
    return F.to_json(F.struct(
        F.when(k % 19 == 0, "").otherwise(text(c("audit_id"))).alias("auditID"), "verb",
        F.struct(c("actor").alias("username"),
                 F.array(F.concat(F.lit("g"), text(k % 3)), F.lit("all")).alias("groups")).alias("user"),
        F.struct(c("imp").alias("username")).alias("impersonatedUser"),
        F.struct("resource", c("sub").alias("subresource"), c("ns").alias("namespace"),
                 F.concat(F.lit("n"), text(k)).alias("name"),
                 F.concat(F.lit("g"), text(k % 2)).alias("apiGroup")).alias("objectRef"),
        F.struct("code").alias("responseStatus"),
        F.create_map(F.lit("authorization.k8s.io/decision"), c("decision")).alias("annotations"),
        F.array("source_ip").alias("sourceIPs"), F.lit("kubectl").alias("userAgent"),
        F.concat(F.lit("/api/"), c("resource")).alias("requestURI"),
        F.lit("ResponseComplete").alias("stage"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("requestReceivedTimestamp"),
        body.alias("requestObject")))


def audit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-store rows: time, category and JSON text.

    One in eleven is sent twice; some lines are unreadable and some are blank.
    """
    k = F.col("k")
    line = F.when(k % 29 == 0, '{"auditID": broken').when(k % 31 == 0, "  ").otherwise(_json_line())
    # The text comes out of a generator, so filters on it do not move below and build it again.
    copies = F.when(k % 11 == 0, 2).otherwise(1)
    return audit_from(events(spark, sf_dir)).select(
        F.col("ts").alias("time_generated"), "us", F.col("audit_id").alias("seq"), "k",
        F.when(k % 2 == 0, "kube-audit").when(k % 23 == 1, "other")
        .otherwise("kube-audit-admin").alias("category"),
        F.posexplode(F.array_repeat(line, copies)).alias("copy", "log_s"))


# ---- the same views for the SQL side --------------------------------------------------------

def _duck(expr: str) -> str:
    return expr.replace("AS STRING", "AS VARCHAR")


def _duck_select(columns: dict[str, str], keep: str, source: str) -> str:
    cols = ", ".join(f"{_duck(e)} AS {n}" for n, e in columns.items())
    return f"SELECT {keep}, {cols} FROM {source}"


EV = f"ev AS (SELECT *, epoch_us(ts) AS us, {K_INT} AS k FROM events)"
AUDIT = f"{EV}, audit AS ({_duck_select(AUDIT_COLUMNS, 'ts, us, k, user_id, value', 'ev')})"
PRED = f"{EV}, pred AS ({_duck_select(PRED_COLUMNS, 'ts, us, k', 'ev')})"
FLOW = f"flow AS ({_duck_select(FLOW_COLUMNS, 'l_shipdate', 'lineitem')})"
# The fields the JSON lines carry, without going through JSON text.
LINES = f"""{AUDIT}, lines AS (
  SELECT a.*, copy, CASE WHEN k % 2 = 0 THEN 'kube-audit' WHEN k % 23 = 1 THEN 'other'
    ELSE 'kube-audit-admin' END AS category,
    k % 29 = 0 AS broken, k % 29 <> 0 AND k % 31 = 0 AS blank,
    CASE WHEN k % 19 = 0 THEN '' ELSE CAST(audit_id AS VARCHAR) END AS json_id
  FROM audit a, UNNEST(CASE WHEN k % 11 = 0 THEN [0, 1] ELSE [0] END) AS u(copy))"""
