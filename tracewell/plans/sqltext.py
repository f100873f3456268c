"""SQL fragments shared by the counterparts of the window, episode and score queries."""

from tracewell.functions import constants as K
from tracewell.plans.views import AUDIT, PRED


def names(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


RBAC = names(K.RBAC_RESOURCES)
PRED_SECRET = f"(resource = 'secrets' AND verb IN ({names(K.READ_VERBS)}))"
PRED_RBW = f"(resource IN ({RBAC}) AND verb IN ({names(K.RBAC_WRITE_VERBS)}))"
PRED_CRB = f"(resource IN ({names(K.CLUSTER_BINDING_RESOURCES)}) AND verb = 'create')"
PRED_WORKLOAD = f"(verb = 'create' AND resource IN ({names(K.WORKLOAD_RESOURCES)}))"
PRED_CSR = "(resource = 'certificatesigningrequests')"
PRED_TOKEN = "(verb = 'create' AND resource = 'serviceaccounts' AND sub = 'token')"
PRED_REVIEW = f"(verb = 'create' AND resource IN ({names(K.SELF_REVIEW_RESOURCES)}))"


def _count(cond: str, frame: str = "w") -> str:
    return f"CAST(count(*) FILTER (WHERE {cond}) OVER {frame} AS BIGINT)"


def _distinct(value: str, frame: str = "w") -> str:
    return f"CAST(count(DISTINCT {value}) OVER {frame} AS BIGINT)"


_RAW = {
    "n_events": "CAST(count(*) OVER w AS BIGINT)",
    "n_forbid": _count("decision = 'forbid'"),
    "n_distinct_resource": _distinct("resource"),
    "n_distinct_verb": _distinct("verb"),
    "n_distinct_ns": _distinct("ns"),
    "n_distinct_srcip": _distinct("source_ip"),
    "n_secrets": _count("resource = 'secrets'"),
    "n_exec": _count("sub = 'exec'"),
    "n_rbac": _count(f"resource IN ({RBAC})"),
    "n_create": _count("verb = 'create'"),
    "n_delete": _count("verb = 'delete'"),
    "n_list": _count("verb = 'list'"),
    "n_4xx": _count("code >= 400"),
    "n_selfreview": _count(PRED_REVIEW),
    "n_create_workload": _count(PRED_WORKLOAD),
    "n_distinct_impersonated": _distinct("CASE WHEN is_imp = 1 THEN imp END"),
    "secret_ns": _distinct(f"CASE WHEN {PRED_SECRET} THEN ns END"),
    "c_secret": _count(PRED_SECRET), "c_rbw": _count(PRED_RBW), "c_crb": _count(PRED_CRB),
    "c_imp": _count("is_imp = 1"), "c_csr": _count(PRED_CSR), "c_tok": _count(PRED_TOKEN),
    "cum_secrets": _count(PRED_SECRET, "c"), "cum_rbac_w": _count(PRED_RBW, "c"),
    "cum_exec": _count("sub = 'exec'", "c"), "cum_crb": _count(PRED_CRB, "c"),
}
_FLAGS = {
    "has_secret": "c_secret", "has_exec": "n_exec", "has_rbac_write": "c_rbw", "has_crb": "c_crb",
    "has_forbid": "n_forbid", "has_impersonation": "c_imp", "has_csr": "c_csr",
    "has_tokenreq": "c_tok",
}


def features_cte(source: str = "audit", out: str = "feat") -> str:
    raw = ", ".join(f"{e} AS {n}" for n, e in _RAW.items())
    flags = ", ".join(f"CAST({c} > 0 AS BIGINT) AS {n}" for n, c in _FLAGS.items())
    return f"""{out}_raw AS (SELECT *, {raw} FROM {source}
      WINDOW w AS (PARTITION BY session, actor ORDER BY us, audit_id
                   ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
             c AS (PARTITION BY session, actor ORDER BY us, audit_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    {out}_flag AS (SELECT *, {flags} FROM {out}_raw),
    {out} AS (SELECT *, round_even(n_forbid / n_events, 3) AS forbid_ratio,
      round_even(n_secrets / n_events, 3) AS secret_rate,
      round_even(n_rbac / n_events, 3) AS rbac_rate,
      round_even(n_create / n_events, 3) AS create_rate,
      CASE WHEN n_events >= 20 THEN round_even(n_selfreview / n_events, 3) ELSE 0.0 END
        AS selfreview_ratio,
      CAST(3 * has_crb + 2 * has_exec + 2 * CAST(secret_ns >= 2 AS BIGINT) + has_rbac_write
        + 2 * has_impersonation AS BIGINT) AS severity FROM {out}_flag)"""


FEATURES = f"{AUDIT}, {features_cte()}"

# ---- labels -------------------------------------------------------------------------------
_TOOL = " ".join(
    "WHEN " + " OR ".join(f"contains(actor, '{k}')" for k in keys) + f" THEN '{tool}'"
    for keys, tool in K.TOOL_RULES)
TOOL = f"CASE {_TOOL} ELSE 'synthetic' END"
SYN = " OR ".join(f"contains(actor, '{k}')" for k in K.SYNTHETIC_ATTACK_KEYS)
UID = "string_split(actor, ':')[-1]"
RECON = " OR ".join(f"contains({UID}, '{k}')" for k in K.RECON_KEYS)
ALLOWED = f"(actor IN ({names(K.ALLOW_EXACT)}) OR " + " OR ".join(
    f"starts_with(actor, '{p}')" for p in K.ALLOW_PREFIX) + ")"


def part_case() -> str:
    tr = {t: names(v) for t, v in K.TRAIN_IDENTITIES.items()}
    direct = " ".join(f"WHEN tool = '{t}' THEN '{t}_eval'" for t in (
        "stratus", "peirates", "lowslow", "persistence", "lateralext", "compromised"))
    return f"""CASE WHEN tool = 'rakkess' THEN 'recon_eval' {direct}
      WHEN tool = 'lateral' THEN CASE WHEN uid IN ({tr['lateral']}) THEN 'train' ELSE 'lateral_eval' END
      WHEN tool = 'escv' THEN CASE WHEN uid IN ({tr['escv']}) THEN 'train' ELSE 'escv_eval' END
      WHEN tool = 'impact' THEN CASE WHEN uid IN ({tr['impact']}) THEN 'train'
        WHEN contains(uid, 'impv') THEN 'impact_eval' ELSE 'drop' END
      WHEN tool = 'evasion' THEN CASE WHEN uid IN ({tr['evasion']}) THEN 'train'
        WHEN contains(uid, 'evav') THEN 'evasion_eval' ELSE 'drop' END
      WHEN recon THEN CASE WHEN session IN (5, 6) THEN 'recon_eval' ELSE 'train_recon_excl' END
      WHEN session IN (5, 6) THEN 'test' ELSE 'train' END"""


# Labelled windows with a deterministic score, so that evaluation has something to evaluate.
SCORE = "(severity * 7 + n_forbid * 3 + n_delete * 5 + k % 10) / 130.0"
LABELLED_TAIL = f"""lab0 AS (SELECT *, {TOOL} AS tool, {UID} AS uid, ({RECON}) AS recon,
    {ALLOWED} AS allowed FROM feat),
  lab1 AS (SELECT *, CAST(tool IN ({names(K.ATTACK_TOOLS)}) OR {SYN} AS INT) AS label,
    {part_case()} AS part, CAST({SCORE} AS DOUBLE) AS prob FROM lab0)"""
LABELLED = f"{FEATURES}, {LABELLED_TAIL}"

CATEGORY = "CASE " + " ".join(
    f"WHEN part = '{p}' THEN '{c}'" for p, c in K.PART_CATEGORY.items()) + """
  WHEN part = 'test' AND label = 1 AND NOT recon THEN 'IN-DIST escalation (synthetic)'
  WHEN part = 'test' AND label = 1 THEN 'IN-DIST recon-sa'
  WHEN part = 'test' AND (contains(uid, 'ci-deployer') OR contains(uid, 'compliance'))
    THEN 'BENIGN can-i'
  WHEN part = 'test' THEN 'BENIGN normal' END"""

VEC = [c for c in K.EVAL_FEATURES]


def vec_cols(alias: str = "") -> str:
    p = f"{alias}." if alias else ""
    return ", ".join(f"round_even(CAST({p}{c} AS DOUBLE), 4) AS {c}" for c in VEC)


# ---- score curves -------------------------------------------------------------------------
def points_cte(source: str, key: str | None = None, score: str = "prob", label: str = "label",
               out: str = "pts") -> str:
    k, part = (f"{key}, ", f"PARTITION BY {key}") if key else ("", "")
    group = f"{k}{score}"
    return f"""{out}_c AS (SELECT {group} AS threshold,
      CAST(count(*) FILTER (WHERE {label} = 1) AS BIGINT) AS p,
      CAST(count(*) FILTER (WHERE {label} <> 1) AS BIGINT) AS n FROM {source} GROUP BY {group}),
    {out} AS (SELECT *, CAST(sum(p) OVER o AS BIGINT) AS tp, CAST(sum(n) OVER o AS BIGINT) AS fp,
      CAST(sum(p) OVER a AS BIGINT) AS pos, CAST(sum(n) OVER a AS BIGINT) AS neg FROM {out}_c
      WINDOW o AS ({part} ORDER BY threshold DESC), a AS ({part}))"""


AUC = "sum(CAST(n AS DOUBLE) * (tp - p / 2)) / nullif(max(CAST(pos AS DOUBLE)) * max(neg), 0)"
AP = "sum(CAST(p AS DOUBLE) * tp / (tp + fp)) / nullif(max(pos), 0)"
PRED_POINTS = f"{PRED}, {points_cte('pred')}"


def confusion_sql(source: str, cond: str = "prob >= 0.5", key: str = "", out: str = "conf") -> str:
    """CTE with the counts and metrics of a prediction per key."""
    k = f"{key}, " if key else ""
    g = f"GROUP BY {key}" if key else ""
    div = lambda a, b: f"CASE WHEN {b} = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / ({b}) END"
    return f"""{out}_c AS (SELECT {k}
      CAST(count(*) FILTER (WHERE ({cond}) AND label = 1) AS BIGINT) AS tp,
      CAST(count(*) FILTER (WHERE ({cond}) AND label <> 1) AS BIGINT) AS fp,
      CAST(count(*) FILTER (WHERE NOT ({cond}) AND label <> 1) AS BIGINT) AS tn,
      CAST(count(*) FILTER (WHERE NOT ({cond}) AND label = 1) AS BIGINT) AS fn
      FROM {source} {g}),
    {out} AS (SELECT *, {div('tp + tn', 'tp + fp + tn + fn')} AS accuracy,
      {div('tp', 'tp + fp')} AS precision, {div('tp', 'tp + fn')} AS recall,
      {div('2 * tp', '2 * tp + fp + fn')} AS f1, {div('fp', 'fp + tn')} AS fpr FROM {out}_c)"""
