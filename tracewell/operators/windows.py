"""Per-actor look-back features: row frames, range frames and running totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import constants as K
from tracewell.functions import predicates as P
from tracewell.functions.scalars import flag, ratio3
from tracewell.operators.partition import split_hot_groups

GROUP = ["session", "actor"]
ORDER = ["us", "audit_id"]


def counted_conditions() -> dict[str, Column]:
    """Per-event conditions whose last-20 counts the features need."""
    return {
        "n_forbid": F.col("decision") == "forbid",
        "n_secrets": F.col("resource") == "secrets",
        "n_exec": F.col("sub") == "exec",
        "n_rbac": F.col("resource").isin(K.RBAC_RESOURCES),
        "n_create": F.col("verb") == "create",
        "n_delete": F.col("verb") == "delete",
        "n_list": F.col("verb") == "list",
        "n_4xx": F.col("code") >= 400,
        "n_selfreview": P.self_review(),
        "n_create_workload": P.workload_create(),
        "_secret": P.secret_read(),
        "_rbw": P.rbac_write(),
        "_crb": P.binding_create(),
        "_imp": F.col("is_imp") == 1,
        "_csr": P.signing_request(),
        "_tok": P.token_request(),
    }


def distinct_values() -> dict[str, Column]:
    """Values whose distinct counts over the last events the features need."""
    return {
        "n_distinct_resource": F.col("resource"),
        "n_distinct_verb": F.col("verb"),
        "n_distinct_ns": F.col("ns"),
        "n_distinct_impersonated": F.when(F.col("is_imp") == 1, F.col("imp")),
        "secret_ns": F.when(P.secret_read(), F.col("ns")),
    }


CUMULATIVE = {
    "secrets": P.secret_read,
    "rbac_w": P.rbac_write,
    "exec": lambda: F.col("sub") == "exec",
    "crb": P.binding_create,
}


def last_rows_frame(keys: list[str], size: int = K.WINDOW_EVENTS):
    """Frames over one chunk: (last ``size`` rows, everything so far, plain order)."""
    order = Window.partitionBy(*keys, "_chunk").orderBy(*ORDER)
    return (order.rowsBetween(-(size - 1), 0),
            order.rowsBetween(Window.unboundedPreceding, 0), order)


def window_features(
    events: DataFrame, keys: list[str] = GROUP, size: int = K.WINDOW_EVENTS,
    extra: dict[str, Column] | None = None, context: str | None = None, **split
) -> DataFrame:
    """The 34-feature table, one row per event; ``extra`` adds distinct counts of other values.

    Rows flagged by the boolean column ``context`` only serve as look-back for later rows: they
    are not counted in the running totals and not returned.

    Counts over the last ``size`` events are differences of running sums ``size`` rows apart, so
    each row costs the same whatever the frame; only the distinct counts look at the frame itself.
    """
    counted, extra = counted_conditions(), extra or {}
    cum = {name: make() for name, make in CUMULATIVE.items()}
    if context:
        cum = {name: cond & ~F.col(context) for name, cond in cum.items()}
    df = split_hot_groups(events, keys, halo_rows=size - 1, totals=cum, **split)
    if context:
        df = df.withColumn("_halo", F.col("_halo") | F.col(context))
    frame, so_far, order = last_rows_frame(keys, size)
    df = df.withColumns({f"_f{c}": flag(cond) for c, cond in counted.items()})
    df = df.withColumns({
        "_row": F.row_number().over(order),
        **{f"_r{c}": F.sum(f"_f{c}").over(so_far) for c in counted},
        # Running totals skip the repeated rows and start from the earlier chunks.
        **{f"cum_{c}": F.sum(flag(cond & ~F.col("_halo"))).over(so_far) + F.col(f"_base_{c}")
           for c, cond in cum.items()},
        **{name: F.size(F.collect_set(c).over(frame)) for name, c in {**distinct_values(), **extra}.items()},
    })
    df = df.withColumns({
        "n_events": F.least(F.col("_row"), F.lit(size)),
        **{c: F.col(f"_r{c}") - F.coalesce(F.lag(f"_r{c}", size).over(order), F.lit(0))
           for c in counted},
    }).where(~F.col("_halo"))
    return derived_features(df, events.columns, size, list(extra))


def derived_features(df: DataFrame, columns: list[str], size: int, extra: list[str] = []) -> DataFrame:
    """``columns`` and the features of rows that carry the counts over their last ``size`` events."""
    has = {"has_secret": "_secret", "has_exec": "n_exec", "has_rbac_write": "_rbw",
           "has_crb": "_crb", "has_forbid": "n_forbid", "has_impersonation": "_imp",
           "has_csr": "_csr", "has_tokenreq": "_tok"}
    df = df.withColumns({name: flag(F.col(src) > 0) for name, src in has.items()})
    df = df.withColumns({
        "forbid_ratio": ratio3(F.col("n_forbid"), F.col("n_events")),
        "secret_rate": ratio3(F.col("n_secrets"), F.col("n_events")),
        "rbac_rate": ratio3(F.col("n_rbac"), F.col("n_events")),
        "create_rate": ratio3(F.col("n_create"), F.col("n_events")),
        "selfreview_ratio": F.when(
            F.col("n_events") >= size, ratio3(F.col("n_selfreview"), F.col("n_events"))
        ).otherwise(F.lit(0.0)),
        "severity": (3 * F.col("has_crb") + 2 * F.col("has_exec")
                     + 2 * flag(F.col("secret_ns") >= 2) + F.col("has_rbac_write")
                     + 2 * F.col("has_impersonation")),
    })
    ratios = {"forbid_ratio", "secret_rate", "rbac_rate", "create_rate", "selfreview_ratio"}
    return df.select(*columns, *[
        F.col(c).cast("double" if c in ratios else "bigint").alias(c)
        for c in [*K.ALL_FEATURES, *extra]])


RICH_FEATURES = ["n_events", "n_forbid", "forbid_ratio", "n_distinct_resource", "n_distinct_verb",
                 "n_distinct_ns", "n_secrets", "n_exec", "n_rbac", "n_create", "n_delete",
                 "n_list", "n_4xx", "n_distinct_srcip"]


def rich_features(
    events: DataFrame, keys: list[str] = GROUP, size: int = K.WINDOW_EVENTS, **split
) -> DataFrame:
    """The older 14-feature set with distinct source addresses."""
    full = window_features(events, keys, size, extra={"n_distinct_srcip": F.col("source_ip")},
                           **split)
    return full.select(*events.columns, *RICH_FEATURES)


def _over_last(events: DataFrame, keys: list[str], size: int, expr, name: str,
               context: str | None = None, **split) -> DataFrame:
    df = split_hot_groups(events, keys, halo_rows=size - 1, **split)
    if context:
        df = df.withColumn("_halo", F.col("_halo") | F.col(context))
    frame, _, _ = last_rows_frame(keys, size)
    return df.withColumn(name, expr(frame)).where(~F.col("_halo")).select(*events.columns, name)


def longest_burst(
    events: DataFrame, keys: list[str] = GROUP, size: int = K.WINDOW_EVENTS, **split
) -> DataFrame:
    """Longest run of consecutive self reviews inside each window."""
    def fold(frame):
        flags = F.collect_list(flag(P.self_review())).over(frame)
        end = F.aggregate(
            flags, F.struct(F.lit(0).alias("run"), F.lit(0).alias("best")),
            lambda acc, x: F.struct(
                F.when(x == 1, acc["run"] + 1).otherwise(0).alias("run"),
                F.greatest(acc["best"], F.when(x == 1, acc["run"] + 1).otherwise(0)).alias("best")))
        return end["best"].cast("bigint")
    return _over_last(events, keys, size, fold, "burst_max", **split)


def token_column() -> Column:
    return F.concat_ws(":", F.coalesce("verb", F.lit("")), F.coalesce("resource", F.lit("")),
                       F.coalesce("sub", F.lit("")))


def token_windows(
    events: DataFrame, keys: list[str] = GROUP, size: int = K.WINDOW_EVENTS, pad: bool = True,
    **split
) -> DataFrame:
    """Last ``size`` tokens of the actor, left-padded to full length."""
    def collect(frame):
        seq = F.collect_list("token").over(frame)
        if not pad:
            return seq
        return F.concat(F.array_repeat(F.lit("<PAD>"), F.lit(size) - F.size(seq)), seq)
    return _over_last(events.withColumn("token", token_column()), keys, size, collect, "tokens",
                      **split)


def time_features(events: DataFrame, keys: list[str] = ["actor"], **split) -> DataFrame:
    """Look-back rates over the last 5 s and 60 s, bounds included, later peers excluded.

    Each event enters the running sums at its own time and leaves them right after it expires, so
    a look-back count is a plain running sum and never rescans its frame, however busy the actor.
    For distinct values only the first of a run of occurrences enters and only the last leaves.
    """
    short, long = 5_000_000, 60_000_000
    parts = [*keys, "_chunk"]
    df = split_hot_groups(events, keys, halo_rows=1, halo_us=long, **split)
    df = df.repartition(*parts)
    ins = {}
    for name in ("resource", "verb"):
        same = Window.partitionBy(*parts, name).orderBy(*ORDER)
        ins[f"_in_{name}"] = flag(F.coalesce(
            F.col("us") - F.lag("us").over(same) > long, F.lit(True)))
        ins[f"_out_{name}"] = flag(F.coalesce(
            F.lead("us").over(same) - F.col("us") > long, F.lit(True)))
    df = df.withColumns(ins).withColumns({
        "_err": flag(F.substring(F.col("code").cast("string"), 1, 1).isin("4", "5")),
        "_ro": flag(F.col("verb").isin(K.READ_VERBS)),
    })
    names = ["n5", "n60", "res", "verb", "err", "ro"]

    def step(at: Column, kind: int, values: list[Column]) -> Column:
        return F.struct(at.alias("_t"), F.lit(kind).alias("_kind"),
                        *[v.cast("bigint").alias(f"_d_{n}") for v, n in zip(values, names)])

    zero, one = F.lit(0), F.lit(1)
    df = df.withColumn("_s", F.explode(F.array(
        step(F.col("us"), 0, [one, one, F.col("_in_resource"), F.col("_in_verb"),
                              F.col("_err"), F.col("_ro")]),
        step(F.col("us") + short, 1, [-one, zero, zero, zero, zero, zero]),
        step(F.col("us") + long, 1, [zero, -one, -F.col("_out_resource"), -F.col("_out_verb"),
                                     -F.col("_err"), -F.col("_ro")]))))
    df = df.select("*", "_s.*")
    order = Window.partitionBy(*parts).orderBy("_t", "_kind", "audit_id")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({
        **{f"_w_{n}": F.sum(f"_d_{n}").over(so_far) for n in names},
        "_prev": F.last(F.when(F.col("_kind") == 0, F.col("us")), ignorenulls=True).over(earlier),
    }).where((F.col("_kind") == 0) & ~F.col("_halo"))
    return df.select(
        *events.columns,
        F.col("_w_n5").alias("events_5s"),
        F.col("_w_n60").alias("events_60s"),
        F.col("_w_res").alias("distinct_resources_60s"),
        F.col("_w_verb").alias("distinct_verbs_60s"),
        F.col("_w_err").alias("errors_60s"),
        (F.col("_w_ro") / F.col("_w_n60")).cast("double").alias("readonly_ratio_60s"),
        F.coalesce((F.col("us") - F.col("_prev")) / 1e6, F.lit(-1.0)).alias("secs_since_prev"),
    )


def last_window(features: DataFrame, keys: list[str] = GROUP) -> DataFrame:
    """The newest feature row of each group, by a map-side combined maximum."""
    rest = [c for c in features.columns if c not in keys]
    return features.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*ORDER)).alias("_w")).select(*keys, "_w.*")
