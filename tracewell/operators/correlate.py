"""Alert correlation: thresholds, calibration, sessions, chains, severity.

No step gathers an actor's or an incident's alerts. Alerts are first combined per actor and per
time bucket of one gap; two alerts in a bucket are always in the same incident, so incidents are
found on that small table. Chains are matched with first/last positions instead of lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import constants as K
from tracewell.functions.scalars import any_of, parse_iso, severity_band, sigmoid
from tracewell.operators.joins import pod_actor
from tracewell.operators.partition import running_totals
from tracewell.session import broadcast_if_small

GAP_SECONDS = 60


def alerts_from_predictions(df: DataFrame) -> DataFrame:
    """Prediction rows to alerts; the hint is the attack type of labelled rows."""
    hint = F.when(F.col("label") == 1, F.coalesce("attack_type", F.lit(""))).otherwise("")
    return df.where(F.col("us").isNotNull()).select(
        F.col("row_id").alias("seq"), "us", "actor", "component",
        F.col("prob").alias("raw_score"), hint.alias("hint"))


def tactic_of(rule: Column, output: Column) -> Column:
    text = F.lower(F.concat_ws(" ", F.coalesce(rule, F.lit("")), F.coalesce(output, F.lit(""))))
    expr = F.lit("")
    for words, tactic in reversed(K.TACTIC_KEYWORDS):
        expr = F.when(any_of([text.contains(w) for w in words]), tactic).otherwise(expr)
    return expr


def alerts_from_syscalls(df: DataFrame, pods: DataFrame | None = None) -> DataFrame:
    """Syscall alerts to correlator alerts; rows without a readable time are dropped."""
    score = F.lit(K.DEFAULT_PRIORITY_SCORE)
    for name, value in K.PRIORITY_SCORE.items():
        score = F.when(F.col("priority") == name, value).otherwise(score)
    field = lambda k: F.nullif(
        F.coalesce(F.try_element_at("output_fields", F.lit(k)), F.lit("")), F.lit(""))
    out = df.withColumns({
        "ts": parse_iso(F.col("time")),
        "pod": F.coalesce(field("k8s.pod.name"), field("k8s_pod_name"), F.lit("")),
        "raw_score": score,
        "hint": tactic_of(F.col("rule"), F.col("output")),
        "component": F.lit(K.SYSCALL_COMPONENT),
    }).where(F.col("ts").isNotNull()).withColumn("us", F.unix_micros("ts"))
    if pods is None:
        pods = df.sparkSession.createDataFrame([], "pod string, actor string")
    return pod_actor(out, pods).select(
        *[c for c in ("seq",) if c in df.columns], "us", "actor", "component", "raw_score", "hint")


def apply_thresholds(alerts: DataFrame, thresholds: DataFrame, default: float = 0.5) -> DataFrame:
    """Keep alerts at or over their component's threshold."""
    small = broadcast_if_small(thresholds.select("component", "threshold"))
    return (alerts.join(small, "component", "left")
            .where(F.col("raw_score") >= F.coalesce("threshold", F.lit(default)))
            .drop("threshold"))


def calibrate(alerts: DataFrame, calibrators: DataFrame | None = None) -> DataFrame:
    """Logistic calibration per component; identity for components without one."""
    if calibrators is None:
        return alerts.withColumn("calibrated", F.col("raw_score"))
    small = broadcast_if_small(calibrators.select("component", "coef", "intercept"))
    out = alerts.join(small, "component", "left")
    score = sigmoid(F.col("coef") * F.col("raw_score") + F.col("intercept"))
    return out.withColumn("calibrated", F.coalesce(score, "raw_score")).drop("coef", "intercept")


def with_slot(alerts: DataFrame, gap_seconds: int = GAP_SECONDS) -> DataFrame:
    return alerts.withColumn("_slot", F.floor(F.col("us") / (gap_seconds * 1_000_000)))


def incident_slots(alerts: DataFrame, keys: list[str] = ["actor"], gap_seconds: int = GAP_SECONDS
                   ) -> DataFrame:
    """(keys, slot) -> incident start. At most one row per group and gap-wide slot."""
    slots = with_slot(alerts, gap_seconds).groupBy(*keys, "_slot").agg(
        F.min("us").alias("_first"), F.max("us").alias("_last"))
    order = Window.partitionBy(*keys).orderBy("_slot")
    new = F.col("_first") - F.lag("_last").over(order) > gap_seconds * 1_000_000
    slots = slots.withColumn("_new", F.coalesce(new, F.lit(True)))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    return slots.select(*keys, "_slot", F.last(
        F.when(F.col("_new"), F.col("_first")), ignorenulls=True).over(so_far).alias("start_us"))


def assign_incidents(alerts: DataFrame, keys: list[str] = ["actor"],
                     gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """Alerts with ``start_us``, the start of their incident."""
    return with_slot(alerts, gap_seconds).join(
        incident_slots(alerts, keys, gap_seconds), [*keys, "_slot"]).drop("_slot")


def assemble(assigned: DataFrame, keys: list[str] = ["actor"]) -> DataFrame:
    """One row per incident; the ordered hints are in ``incident_sequence``."""
    return assigned.groupBy(*keys, "start_us").agg(
        F.max("us").alias("end_us"), F.count(F.lit(1)).alias("n_alerts"),
        F.array_join(F.sort_array(F.collect_set("component")), "|").alias("components"),
        F.count_if(F.col("hint") != "").alias("n_hints"),
        F.max("calibrated").alias("base_score"))


def incident_sequence(assigned: DataFrame, keys: list[str] = ["actor"], part_rows: int = 10_000
                      ) -> DataFrame:
    """The ordered hints of every incident, at most ``part_rows`` of them per row.

    An incident's rows in ``part`` order give its attack sequence. One part is the rule; a very
    long incident has many, so no row holds all of it.
    """
    group = [*keys, "start_us"]
    pos = running_totals(assigned.where(F.col("hint") != ""), [F.col("us"), F.col("seq")],
                         F.floor(F.col("us") / 60_000_000), {"_pos": F.lit(1)}, group)
    part = F.floor((F.col("_pos") - 1) / part_rows)
    return pos.groupBy(*group, part.alias("part")).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("_pos", "hint"))), lambda x: x["hint"]).alias("hints"))


def match_chains(assigned: DataFrame, keys: list[str] = ["actor"], chains=K.CHAINS) -> DataFrame:
    """Strongest chain occurring in order within each incident that has one.

    Outer tokens shrink inwards round by round: the earliest position of the first and the latest
    of the last token, then of the tokens next to them between those bounds. All are minimum and
    maximum aggregates, combined before the shuffle.
    """
    group = [*keys, "start_us"]
    words = sorted({t for _, seq, _ in chains for t in seq})
    hints = assigned.where(F.col("hint").isin(words)).select(
        *group, "hint", F.struct("us", "seq").alias("_at"))
    bounds = None
    for depth in range(max((len(seq) + 1) // 2 for _, seq, _ in chains)):
        live = [(i, seq) for i, (_, seq, _) in enumerate(chains) if depth <= len(seq) - 1 - depth]
        aggs = []
        for i, seq in live:
            inside = F.lit(True) if bounds is None else (
                (F.col("_at") > F.col(f"_l{i}")) & (F.col("_at") < F.col(f"_r{i}")))
            is_left, is_right = F.col("hint") == seq[depth], F.col("hint") == seq[-1 - depth]
            aggs += [F.min(F.when(inside & is_left, F.col("_at"))).alias(f"_nl{i}"),
                     F.max(F.when(inside & is_right, F.col("_at"))).alias(f"_nr{i}")]
        if bounds is None:
            bounds = hints.groupBy(*group).agg(*aggs).withColumnsRenamed(
                {f"_n{side}{i}": f"_{side}{i}" for i, _ in live for side in "lr"})
            continue
        # Only incidents with an outer pair in order, and only the tokens asked for, come back.
        wanted = sorted({t for _, seq in live for t in (seq[depth], seq[-1 - depth])})
        open_ = any_of([F.col(f"_l{i}") < F.col(f"_r{i}") for i, _ in live])
        fresh = (hints.where(F.col("hint").isin(wanted)).join(bounds.where(open_), group)
                 .groupBy(*group).agg(*aggs))
        inner = {i for i, _ in live}
        bounds = bounds.join(fresh, group, "left").select(*group, *[
            F.col(f"_n{side}{i}" if i in inner else f"_{side}{i}").alias(f"_{side}{i}")
            for i in range(len(chains)) for side in "lr"])
    options = []
    for i, (name, seq, boost) in enumerate(chains):
        # An even chain ends on two neighbours, an odd one on a single middle token.
        done = (F.col(f"_l{i}") < F.col(f"_r{i}")) if len(seq) % 2 == 0 else F.col(f"_l{i}").isNotNull()
        options.append(F.when(done, F.struct(
            F.lit(float(boost)).alias("boost"), F.lit(-i).alias("rank"), F.lit(name).alias("chain"))))
    best = F.array_max(F.array_compact(F.array(*options)))
    return (bounds.withColumn("_c", best).where(F.col("_c").isNotNull())
            .select(*group, F.col("_c.chain").alias("chain_matched"), F.col("_c.boost").alias("boost")))


def boost(incidents: DataFrame, matches: DataFrame, keys: list[str] = ["actor"]) -> DataFrame:
    """Multiply the base score by the chain's boost, at most 1."""
    out = incidents.join(matches, [*keys, "start_us"], "left")
    return out.withColumn("boosted_score", F.when(
        F.col("boost").isNotNull(), F.least(F.col("base_score") * F.col("boost"), F.lit(1.0))
    ).otherwise(F.col("base_score"))).drop("boost")


def severity(incidents: DataFrame) -> DataFrame:
    return incidents.withColumn("severity", severity_band(F.col("boosted_score"), floor="LOW"))


def correlate(alerts: DataFrame, thresholds: DataFrame, calibrators: DataFrame | None = None,
              keys: list[str] = ["actor"], gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """All levels: threshold, calibrate, sessions, chains, severity."""
    kept = calibrate(apply_thresholds(alerts, thresholds), calibrators)
    assigned = assign_incidents(kept, keys, gap_seconds)
    incidents = assemble(assigned, keys)
    return severity(boost(incidents, match_chains(assigned, keys), keys))


def score_incidents(incidents: DataFrame, truth: DataFrame) -> DataFrame:
    """Actor precision and recall, incident precision and chain counts in one row."""
    truth = truth.select("actor").distinct().withColumn("_t", F.lit(1))
    per = incidents.groupBy("actor").agg(
        F.count(F.lit(1)).alias("_i"), F.count_if(F.col("n_hints") > 0).alias("_itp"),
        F.count("chain_matched").alias("_ch"))
    out = per.join(truth, "actor", "full_outer").agg(
        F.count_if(F.col("_t").isNotNull() & F.col("_i").isNotNull()).alias("tp"),
        F.count_if(F.col("_t").isNull()).alias("fp"),
        F.count_if(F.col("_i").isNull()).alias("fn"),
        F.coalesce(F.sum("_i"), F.lit(0)).alias("incidents"),
        F.coalesce(F.sum("_itp"), F.lit(0)).alias("incidents_with_attack"),
        F.coalesce(F.sum("_ch"), F.lit(0)).alias("incidents_with_chain"))
    return out.withColumns({
        "precision": F.bround(F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)), 4),
        "recall": F.bround(F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1)), 4),
        "incident_precision": F.bround(
            F.col("incidents_with_attack") / F.greatest("incidents", F.lit(1)), 4)})


def alert_volume(alerts: DataFrame, incidents: DataFrame) -> DataFrame:
    """Reduction from alerts to incidents and the severity distribution, one row per measure."""
    sev = incidents.groupBy("severity").agg(F.count(F.lit(1)).alias("value")).select(
        F.concat(F.lit("severity:"), "severity").alias("measure"), F.col("value").cast("double"))
    chains = incidents.where(F.col("chain_matched").isNotNull()).groupBy("chain_matched").agg(
        F.count(F.lit(1)).alias("value")).select(
        F.concat(F.lit("chain:"), "chain_matched").alias("measure"), F.col("value").cast("double"))
    types = alerts.where(F.col("hint") != "").groupBy("hint").agg(
        F.count(F.lit(1)).alias("value")).select(
        F.concat(F.lit("attack_type:"), "hint").alias("measure"), F.col("value").cast("double"))
    both = (alerts.select(F.lit(1).alias("_raw"), F.lit(0).alias("_inc"))
            .unionByName(incidents.select(F.lit(0).alias("_raw"), F.lit(1).alias("_inc"))))
    ratio = F.bround(1 - F.col("inc") / F.greatest("raw", F.lit(1)), 4)
    head = both.agg(
        F.coalesce(F.sum("_raw"), F.lit(0)).alias("raw"),
        F.coalesce(F.sum("_inc"), F.lit(0)).alias("inc")).select(F.explode(F.array(
        F.struct(F.lit("raw_alerts").alias("measure"), F.col("raw").cast("double").alias("value")),
        F.struct(F.lit("incidents").alias("measure"), F.col("inc").cast("double").alias("value")),
        F.struct(F.lit("dedup_ratio").alias("measure"), ratio.cast("double").alias("value")),
    )).alias("_m")).select("_m.*")
    return head.unionByName(sev).unionByName(chains).unionByName(types)


def plane_comparison(alerts: DataFrame, sets: dict[str, list[str]],
                     gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """The same alerts correlated per plane set (each plane alone and both together)."""
    names = F.array_compact(F.array(*[
        F.when(F.col("plane").isin(members), name) for name, members in sets.items()]))
    spread = alerts.withColumn("plane_set", F.explode(names))
    keys = ["plane_set", "actor"]
    assigned = assign_incidents(calibrate(spread), keys, gap_seconds)
    out = severity(boost(assemble(assigned, keys), match_chains(assigned, keys), keys))
    return out.groupBy("plane_set").agg(
        F.count(F.lit(1)).alias("incidents"), F.count("chain_matched").alias("with_chain"),
        F.count_if(F.col("severity") == "CRITICAL").alias("critical"),
        F.max("boosted_score").alias("top_score"))

