"""Projections, filters and normalisation of audit events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell import schemas
from tracewell.functions import constants as K
from tracewell.functions.scalars import any_of, flag, last_segment, parse_iso


def text(col: str) -> Column:
    """A string field with the empty string for missing values."""
    return F.coalesce(F.col(col), F.lit(""))


def actor_real(user: Column, imp: Column) -> Column:
    """The authenticated user; the impersonated one only where the former is blank."""
    return F.when(user != "", user).otherwise(imp)


def actor_effective(user: Column, imp: Column) -> Column:
    """The older choice: the impersonated user first."""
    return F.when(imp != "", imp).otherwise(user)


def flatten_event(df: DataFrame, event: str = "event", actor_mode: str = "real") -> DataFrame:
    """Nested event struct to the normalised record; other columns are kept."""
    user, imp = text(f"{event}.user.username"), text(f"{event}.impersonatedUser.username")
    is_imp = (imp != "") & (imp != user)
    pick = actor_real if actor_mode == "real" else actor_effective
    return df.withColumns({
        "audit_key": text(f"{event}.auditID"),
        "actor": pick(user, imp),
        "verb": text(f"{event}.verb"),
        "resource": text(f"{event}.objectRef.resource"),
        "sub": text(f"{event}.objectRef.subresource"),
        "ns": text(f"{event}.objectRef.namespace"),
        "code": F.coalesce(F.col(f"{event}.responseStatus.code"), F.lit(0)),
        "decision": F.coalesce(
            F.try_element_at(F.col(f"{event}.annotations"), F.lit(K.DECISION_KEY)), F.lit("")),
        "imp": F.when(is_imp, imp).otherwise(""),
        "is_imp": flag(is_imp),
    }).drop(event)


def flatten_wide(df: DataFrame, event: str = "event") -> DataFrame:
    """Nested event struct to the fourteen text columns of the first generation."""
    c = lambda p: text(f"{event}.{p}")
    received = F.nullif(c("requestReceivedTimestamp"), F.lit(""))
    return df.withColumns({
        "timestamp": F.coalesce(received, F.col(f"{event}.stageTimestamp")),
        "verb": c("verb"),
        "user": c("user.username"),
        "user_groups": F.coalesce(F.concat_ws("|", F.col(f"{event}.user.groups")), F.lit("")),
        "stage": c("stage"),
        "resource": c("objectRef.resource"),
        "subresource": c("objectRef.subresource"),
        "namespace": c("objectRef.namespace"),
        "name": c("objectRef.name"),
        "api_group": c("objectRef.apiGroup"),
        "response_code": F.coalesce(
            F.col(f"{event}.responseStatus.code").cast("string"), F.lit("")),
        "source_ip": F.coalesce(F.get(f"{event}.sourceIPs", F.lit(0)), F.lit("")),
        "user_agent": c("userAgent"),
        "request_uri": c("requestURI"),
    })


def _body(column: str) -> Column:
    return F.from_json(F.col(column), schemas.REQUEST_BODY)


def pod_flags(df: DataFrame, body: str = "request_object") -> DataFrame:
    """Security-relevant settings of a submitted pod spec."""
    out = df.withColumn("_b", _body(body))
    spec = F.col("_b.spec")
    return out.withColumns({
        "pod_privileged": flag(F.exists(
            spec["containers"], lambda x: F.coalesce(x["securityContext"]["privileged"], F.lit(False)))),
        "pod_host_path": flag(F.exists(spec["volumes"], lambda v: F.coalesce(
            ~v["hostPath"].isin("", "{}", "null"), F.lit(False)))),
        "pod_host_pid": flag(spec["hostPID"]),
        "pod_host_network": flag(spec["hostNetwork"]),
        "pod_host_ipc": flag(spec["hostIPC"]),
    }).drop("_b")


def rbac_wildcard(df: DataFrame, body: str = "request_object") -> DataFrame:
    """Flag a role whose rules grant '*' on verbs or resources."""
    has = lambda arr: F.coalesce(F.array_contains(arr, "*"), F.lit(False))
    return (df.withColumn("_b", _body(body)).withColumn("rbac_wildcard", flag(
        F.col("_b.kind").isin("Role", "ClusterRole")
        & F.exists("_b.rules", lambda r: has(r["verbs"]) | has(r["resources"])))).drop("_b"))


def drop_system(df: DataFrame, user: str = "actor") -> DataFrame:
    return df.where((F.col(user) != "") & ~F.col(user).startswith("system:"))


def after_run_start(df: DataFrame, start: Column, ts: str = "ts") -> DataFrame:
    """Events at or after the mark; events without a time are kept."""
    return df.where(F.coalesce(F.col(ts) >= start, F.lit(True)))


def run_start_counts(df: DataFrame, start: Column, ts: str = "ts") -> DataFrame:
    old = F.coalesce(F.col(ts) < start, F.lit(False))
    return df.agg(F.count_if(~old).alias("kept"), F.count_if(old).alias("skipped_old"))


def dedup_id(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First row per id in the given order; rows without an id are all kept.

    One pass and one shuffle. The first row is found by a map-side combined minimum, so an id
    repeated very often costs one row per task. A row without an id is its own group, so the blank
    key spreads over all tasks; exact copies are counted and written out again.
    """
    rest = [c for c in df.columns if c not in (key, *order)]
    blank = F.coalesce(F.col(key), F.lit("")) == ""
    row = F.struct(*order, *rest)
    groups = df.groupBy(key, F.when(blank, row).alias("_own")).agg(
        F.min_by(F.when(~blank, row), F.struct(*order)).alias("_first"),
        F.count(F.lit(1)).alias("_n"))
    copies = F.when(F.col("_own").isNotNull(), F.col("_n")).otherwise(1)
    out = groups.select(key, F.coalesce("_own", "_first").alias("_r"),
                        F.explode(F.sequence(F.lit(1), copies)).alias("_i"))
    return out.select(key, "_r.*").select(*df.columns)


def tool_label(user: Column) -> Column:
    """First matching substring rule.

    The rules are one literal array searched in order, so the user column occurs once and a
    filter on the label stays small when Catalyst pushes it down.
    """
    rules = F.array(*[F.struct(F.array(*[F.lit(k) for k in keys]).alias("keys"),
                               F.lit(tool).alias("tool")) for keys, tool in K.TOOL_RULES])
    hit = F.filter(rules, lambda r: F.exists(r["keys"], lambda k: user.contains(k)))
    return F.coalesce(F.get(hit, 0)["tool"], F.lit(K.DEFAULT_TOOL))


def lookup(mapping: dict[str, str], key: Column) -> Column:
    """Literal map lookup, null for keys that are not listed."""
    items = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.try_element_at(F.create_map(*items), key)


def is_attack(user: Column, tool: Column | None = None) -> Column:
    tool = tool_label(user) if tool is None else tool
    return tool.isin(K.ATTACK_TOOLS) | any_of([user.contains(k) for k in K.SYNTHETIC_ATTACK_KEYS])


def actor_profile(user: Column) -> Column:
    expr = F.lit(None).cast("string")
    for value, name in reversed(K.PROFILE_EQUALS):
        expr = F.when(user == value, name).otherwise(expr)
    for part, name in reversed(K.PROFILE_CONTAINS):
        expr = F.when(user.contains(part), name).otherwise(expr)
    return expr


def identity_flags(user: Column) -> dict[str, Column]:
    return {"is_system_user": flag(user.startswith("system:")),
            "is_service_account": flag(user.startswith("system:serviceaccount:"))}


def response_flags(code_text: Column) -> dict[str, Column]:
    code = F.coalesce(code_text.try_cast("int"), F.lit(0))
    return {
        "resp_2xx": flag((code >= 200) & (code < 300)),
        "resp_4xx": flag((code >= 400) & (code < 500)),
        "resp_403": flag(code == 403),
        "resp_5xx": flag(code >= 500),
    }


def is_recon(user: Column) -> Column:
    return any_of([user.contains(k) for k in K.RECON_KEYS])


def allowed(user: Column) -> Column:
    """Exact name or anchored prefix, never a substring."""
    return user.isin(K.ALLOW_EXACT) | any_of([user.startswith(p) for p in K.ALLOW_PREFIX])


def allowed_substring(user: Column, names: list[str]) -> Column:
    """The older, looser form."""
    return any_of([user.contains(n) for n in names])


def in_scope(df: DataFrame, tool: str = "tool", user: str = "user", label: str = "label") -> DataFrame:
    """Drop recon identities and attack rows of tools that are out of scope."""
    out = F.col(tool).isin(K.OUT_OF_SCOPE_TOOLS) & (F.col(label) == 1)
    return df.where(~is_recon(last_segment(F.col(user))) & ~out)


def keep_deletion_positives(df: DataFrame) -> DataFrame:
    """Among attack rows of the impact tool keep only pure deletion windows."""
    impact = (F.col("tool") == "impact") & (F.col("label") == 1)
    deletion = (F.col("n_delete") >= 1) & (F.col("n_create") == 0)
    return df.where(~(impact & ~deletion))


def category_label(part: Column, label: Column, user: Column) -> Column:
    """Report category of a row, null when it is not reported."""
    uid = last_segment(user)
    control = uid.contains("ci-deployer") | uid.contains("compliance")
    in_test = F.when(label == 1, F.when(
        is_recon(uid), "IN-DIST recon-sa").otherwise("IN-DIST escalation (synthetic)")
    ).when(control, "BENIGN can-i").otherwise("BENIGN normal")
    return F.coalesce(lookup(K.PART_CATEGORY, part), F.when(part == "test", in_test))


def onehot_topk(df: DataFrame, column: str, k: int, ids: list[str]) -> DataFrame:
    """One-hot of the k most frequent values plus ``=other``; ties go to the smaller value."""
    values = top_values(df, {column: k})[column]
    cols = {f"{column}={v or 'none'}": flag(F.col(column) == v) for v in values}
    cols[f"{column}=other"] = flag(~F.col(column).isin(values)) if values else F.lit(1)
    return df.select(*ids, *[c.alias(n) for n, c in cols.items()])


def top_values(df: DataFrame, widths: dict[str, int]) -> dict[str, list[str]]:
    """The most frequent values of each column, all counted in one pass; only they reach the driver."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                                for c in widths]))
    counted = df.select(pairs.alias("p")).groupBy("p.column", "p.value").count()
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("count"), "value"))
    limit = F.element_at(F.create_map(*[F.lit(x) for item in widths.items() for x in item]), F.col("column"))
    rows = counted.withColumn("place", place).where(
        (F.col("place") <= max(widths.values())) & (F.col("place") <= limit)).orderBy("column", "place")
    out: dict[str, list[str]] = {c: [] for c in widths}
    for r in rows.collect():
        out[r["column"]].append(r["value"])
    return out


def tabular_features(df: DataFrame, widths: dict[str, int] = K.ONEHOT_WIDTH) -> DataFrame:
    """One-hots, identity, response and body flags and look-back rates, one row per event."""
    from tracewell.operators.windows import time_features

    timed = time_features(df, ["actor"])
    cols: dict[str, Column] = {}
    widths = {name: width for name, width in widths.items() if name in df.columns}
    for name, values in (top_values(df, widths) if widths else {}).items():
        for v in values:
            cols[f"{name}={v or 'none'}"] = flag(F.col(name) == v)
        cols[f"{name}=other"] = flag(~F.col(name).isin(values)) if values else F.lit(1)
    cols.update(identity_flags(F.col("actor")))
    cols.update(response_flags(F.col("code").cast("string")))
    for name in K.BODY_FLAGS:
        if name in df.columns:
            cols[name] = F.coalesce(F.col(name).try_cast("int"), F.lit(0))
    rates = ["events_5s", "events_60s", "distinct_resources_60s", "distinct_verbs_60s",
             "errors_60s", "readonly_ratio_60s", "secs_since_prev"]
    return timed.select("audit_id", "actor", *[c.alias(n) for n, c in cols.items()],
                        *[F.col(r).alias(f"user_{r}") for r in rates])


def time_order(df: DataFrame, cols: list[str]) -> DataFrame:
    """Total order by range partitioning; Spark sorts partitions in parallel."""
    return df.orderBy(*cols)


def parse_time(df: DataFrame, source: str, target: str = "ts") -> DataFrame:
    return df.withColumn(target, parse_iso(F.col(source)))


def audit_text() -> Column:
    return F.concat(
        F.lit("Kubernetes API audit event where user "), F.col("user"),
        F.lit(" performed action "), F.col("verb"), F.lit(" on resource "), F.col("resource"),
        F.lit(" in namespace "), F.col("namespace"), F.lit(" from source IP "),
        F.col("source_ip"), F.lit(". The API server returned response code "),
        F.col("response_code").cast("string"), F.lit("."))


