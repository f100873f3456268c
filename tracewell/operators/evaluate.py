"""Curves, operating points and metrics over scored rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import constants as K
from tracewell.functions.scalars import flag, safe_div
from tracewell.operators.partition import exact_quantiles, running_totals, unit_bucket


def score_points(df: DataFrame, score: str = "prob", label: str = "label",
                 keys: list[str] | None = None, bucket: Column | None = None) -> DataFrame:
    """One row per distinct score with tp/fp at ``score >= threshold``.

    Rows are counted per score first; the running counts then go bucket by bucket, so neither a
    heavy score nor the global order lands in one task.
    """
    keys = keys or []
    counted = df.groupBy(*keys, score).agg(
        F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n"))
    bucket = unit_bucket(F.col(score)) if bucket is None else bucket
    cum = running_totals(counted, [F.col(score).desc()], -bucket,
                         {"tp": F.col("p"), "fp": F.col("n")}, keys)
    return cum.select(*keys, F.col(score).alias("threshold"), "p", "n", "tp", "fp",
                      F.col("tp_all").alias("pos"), F.col("fp_all").alias("neg"))


def roc_points(points: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return points.select(*(keys or []), "threshold",
                         safe_div(F.col("fp"), F.col("neg")).alias("fpr"),
                         safe_div(F.col("tp"), F.col("pos")).alias("tpr"))


def pr_points(points: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return points.select(*(keys or []), "threshold",
                         safe_div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                         safe_div(F.col("tp"), F.col("pos")).alias("recall"))


def auc_columns() -> dict[str, Column]:
    """ROC area by trapezoids and average precision by steps, as aggregates over score points."""
    d = lambda c: F.col(c).cast("double")
    pos, neg = F.max(d("pos")), F.max(d("neg"))
    return {
        "roc_auc": F.sum(d("n") * (d("tp") - d("p") / 2)) / F.nullif(pos * neg, F.lit(0.0)),
        "pr_auc": F.sum(d("p") * d("tp") / (d("tp") + d("fp"))) / F.nullif(pos, F.lit(0.0)),
    }


def auc(points: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return points.groupBy(*(keys or [])).agg(*[c.alias(n) for n, c in auc_columns().items()])


def best_f1(points: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Threshold of the highest F1; the lowest such threshold on ties."""
    f1 = safe_div(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("pos"))
    pr = pr_points(points.withColumn("_f1", f1), (keys or []) + ["_f1"])
    best = F.max_by(F.struct("threshold", "precision", "recall", F.col("_f1").alias("f1")),
                    F.struct("_f1", -F.col("threshold")))
    return pr.groupBy(*(keys or [])).agg(best.alias("_b")).select(*(keys or []), "_b.*")


def recall_at_fpr(points: DataFrame, target: float, keys: list[str] | None = None) -> DataFrame:
    """Highest recall with FPR <= target; the least FPR point when none qualifies.

    The curve starts at (0, 0) with no threshold, as the fallback point.
    """
    keys = keys or []
    pts = roc_points(points, keys)
    ok = F.col("fpr") <= target
    best = F.max_by(F.when(ok, F.struct("fpr", "tpr", "threshold")),
                    F.when(ok, F.struct("tpr", "threshold")))
    out = pts.groupBy(*keys).agg(best.alias("_b"))
    return out.select(*keys, F.lit(target).alias("target_fpr"),
                      F.coalesce("_b.fpr", F.lit(0.0)).alias("achieved_fpr"),
                      F.coalesce("_b.tpr", F.lit(0.0)).alias("recall"),
                      F.col("_b.threshold").alias("threshold"))


def fpr_at_recall(points: DataFrame, target: float, keys: list[str] | None = None) -> DataFrame:
    """Lowest FPR with recall >= target."""
    keys = keys or []
    pts = roc_points(points, keys)
    ok = F.col("tpr") >= target
    best = F.min_by(F.when(ok, F.struct("fpr", "tpr", "threshold")),
                    F.when(ok, F.struct("fpr", -F.col("threshold"))))
    return pts.groupBy(*keys).agg(best.alias("_b")).select(
        *keys, F.lit(target).alias("target_recall"), F.col("_b.tpr").alias("achieved_recall"),
        F.col("_b.fpr").alias("fpr"))


def threshold_at_fpr(points: DataFrame, target: float, keys: list[str] | None = None
                     ) -> DataFrame:
    """ROC form: threshold of the best recall within the budget, 0.5 when there is none."""
    return recall_at_fpr(points, target, keys).select(
        *(keys or []), F.coalesce("threshold", F.lit(0.5)).alias("threshold"))


def benign_quantile(df: DataFrame, probs: dict[str, float], score: str = "prob",
                    label: str = "label", keys: list[str] | None = None) -> DataFrame:
    """Quantile form: interpolated quantiles of the benign scores."""
    return exact_quantiles(df.where(F.col(label) == 0), score, probs,
                           unit_bucket(F.col(score)), keys)


def confusion_aggs(pred: Column, label: Column) -> list[Column]:
    return [F.count_if(pred & (label == 1)).alias("tp"),
            F.count_if(pred & (label != 1)).alias("fp"),
            F.count_if(~pred & (label != 1)).alias("tn"),
            F.count_if(~pred & (label == 1)).alias("fn")]


def with_metrics(df: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return df.withColumns({
        "accuracy": safe_div(tp + tn, tp + fp + tn + fn),
        "precision": safe_div(tp, tp + fp),
        "recall": safe_div(tp, tp + fn),
        "f1": safe_div(2 * tp, 2 * tp + fp + fn),
        "fpr": safe_div(fp, fp + tn),
    })


def confusion(df: DataFrame, threshold: float = 0.5, score: str = "prob", label: str = "label",
              keys: list[str] | None = None) -> DataFrame:
    grouped = df.groupBy(*(keys or []))
    return with_metrics(grouped.agg(
        *confusion_aggs(F.col(score) >= threshold, F.col(label))))


def per_attack_recall(df: DataFrame, threshold: float = 0.5, keys: list[str] | None = None
                      ) -> DataFrame:
    return df.where(F.col("label") == 1).groupBy(*(keys or []), "attack_type").agg(
        F.count(F.lit(1)).alias("support"),
        F.avg(flag(F.col("prob") >= threshold)).alias("recall"))


def threshold_sweep(df: DataFrame, thresholds: list[float]) -> DataFrame:
    """Metrics at each threshold, from one counting pass.

    Each row falls into the slot of the highest threshold it reaches; counts per slot are then
    summed from the top, so rows are never repeated per threshold.
    """
    steps = sorted(thresholds)
    slot = reduce(lambda acc, t: acc + flag(F.col("prob") >= t), steps, F.lit(0))
    per = df.groupBy(slot.alias("_slot")).agg(
        F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") != 1).alias("n"))
    table = [F.struct(F.lit(float(t)).alias("threshold"), F.lit(i + 1).alias("_need"))
             for i, t in enumerate(steps)]
    spread = per.withColumn("_t", F.explode(F.array(*table))).select("*", "_t.*")
    hit = F.col("_slot") >= F.col("_need")
    counts = spread.groupBy("threshold").agg(
        F.sum(F.when(hit, F.col("p")).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit, F.col("n")).otherwise(0)).alias("tn"),
        F.sum(F.when(~hit, F.col("p")).otherwise(0)).alias("fn"))
    return with_metrics(counts).withColumn(
        "balanced_accuracy",
        (F.col("recall") + safe_div(F.col("tn"), F.col("tn") + F.col("fp"))) / 2)


def operating_points(sweep: DataFrame) -> DataFrame:
    """Best F1, best balanced accuracy, highest precision at recall >= 0.95 and >= 0.99."""
    row = F.struct("threshold", "f1", "balanced_accuracy", "precision", "recall")
    low = -F.col("threshold")

    def best(name: str, by: str, cond: Column = F.lit(True)) -> Column:
        picked = F.max_by(F.when(cond, row), F.when(cond, F.struct(F.col(by), low)))
        return F.struct(F.lit(name).alias("point"), picked.alias("at"))

    points = F.array(
        best("best_f1", "f1"), best("best_balanced_accuracy", "balanced_accuracy"),
        best("max_precision_recall_95", "precision", F.col("recall") >= 0.95),
        best("max_precision_recall_99", "precision", F.col("recall") >= 0.99))
    return (sweep.agg(points.alias("_p")).select(F.explode("_p").alias("_p"))
            .select("_p.point", "_p.at.*").where(F.col("threshold").isNotNull()))


def group_metrics(attacks: DataFrame, benign: DataFrame, group: str, groups: list[str],
                  thr1: Column, thr5: Column) -> DataFrame:
    """Each of the named attack groups against the common benign pool.

    The pool is counted per score first and only those counts are repeated per group.
    """
    ben = benign.groupBy("prob").agg(F.count(F.lit(1)).alias("n")).withColumn("p", F.lit(0))
    att = attacks.groupBy(group, "prob").agg(F.count(F.lit(1)).alias("p"))
    pool = ben.withColumn(group, F.explode(F.array(*[F.lit(n) for n in groups])))
    both = (att.withColumn("n", F.lit(0).cast("bigint")).select(group, "prob", "p", "n")
            .unionByName(pool.select(group, "prob", F.col("p").cast("bigint"), "n"))
            .groupBy(group, "prob").agg(F.sum("p").alias("p"), F.sum("n").alias("n")))
    cum = running_totals(both, [F.col("prob").desc()], -unit_bucket(F.col("prob")),
                         {"tp": F.col("p"), "fp": F.col("n")}, [group]).withColumns(
        {"pos": F.col("tp_all"), "neg": F.col("fp_all")})
    at = lambda c, t: F.sum(F.when(F.col("prob") >= t, F.col(c)).otherwise(0))
    out = cum.groupBy(group).agg(
        F.sum("p").alias("n"), *[c.alias(n) for n, c in auc_columns().items()],
        at("p", thr1).alias("_tp1"), at("n", thr1).alias("_fp1"),
        at("p", thr5).alias("_tp5"), at("n", thr5).alias("_fp5"))
    return out.select(
        group, "n", "roc_auc", "pr_auc",
        safe_div(F.col("_tp1"), F.col("n")).alias("recall_fpr1"),
        safe_div(F.col("_tp1"), F.col("_tp1") + F.col("_fp1")).alias("precision_fpr1"),
        safe_div(F.col("_tp5"), F.col("n")).alias("recall_fpr5"),
        safe_div(F.col("_tp5"), F.col("_tp5") + F.col("_fp5")).alias("precision_fpr5"))


def brier(df: DataFrame) -> DataFrame:
    return df.agg(F.avg(F.pow(F.col("prob") - F.col("label"), 2)).alias("brier"),
                  F.count(F.lit(1)).alias("rows"))


def calibration_bins(df: DataFrame, bins: int = 10) -> DataFrame:
    """Per score bin: rows, mean score, observed rate; the last bin includes 1."""
    return (df.groupBy(F.least(F.floor(F.col("prob") * bins), F.lit(bins - 1)).alias("bin"))
            .agg(F.count(F.lit(1)).alias("rows"), F.avg("prob").alias("mean_prob"),
                 F.avg("label").alias("rate")))


def ece(df: DataFrame, bins: int = 10) -> DataFrame:
    gap = F.abs(F.col("mean_prob") - F.col("rate")) * F.col("rows")
    return calibration_bins(df, bins).agg((F.sum(gap) / F.sum("rows")).alias("ece"))


def run_detection(df: DataFrame, threshold: Column, k: int = K.HYSTERESIS_K) -> DataFrame:
    """Runs caught per tactic with a total row, benign runs alarmed and overall precision."""
    runs = df.groupBy("tactic", "session", "uid").agg(
        F.count_if(F.col("prob") >= threshold).alias("fired"))
    runs = runs.withColumn("caught", F.col("fired") >= k)
    per = runs.groupBy("tactic").agg(F.count(F.lit(1)).alias("runs"),
                                     F.count_if("caught").alias("caught"))
    attack = per.where(F.col("tactic") != "BENIGN")
    total = per.agg(
        F.lit("TOTAL").alias("tactic"),
        F.coalesce(F.sum(F.when(F.col("tactic") != "BENIGN", F.col("runs"))), F.lit(0)).alias("runs"),
        F.coalesce(F.sum(F.when(F.col("tactic") != "BENIGN", F.col("caught"))), F.lit(0)).alias(
            "caught"),
        F.coalesce(F.sum(F.when(F.col("tactic") == "BENIGN", F.col("caught"))), F.lit(0)).alias(
            "_fp"))
    total = total.withColumn("precision", safe_div(F.col("caught"), F.col("caught") + F.col("_fp")))
    out = (attack.unionByName(per.where(F.col("tactic") == "BENIGN"))
           .withColumn("precision", F.lit(None).cast("double"))
           .unionByName(total.drop("_fp")))
    return out.withColumn("rate", safe_div(F.col("caught"), F.col("runs")))


def heldout_recall(df: DataFrame, threshold: float, features: list[str]) -> DataFrame:
    """All rows are attacks of an unseen tool: share flagged and mean features."""
    return df.groupBy("tool").agg(
        F.count(F.lit(1)).alias("windows"),
        F.avg(flag(F.col("prob") >= threshold)).alias("flagged"),
        *[F.avg(f).alias(f"mean_{f}") for f in features])


def bucket_rates(df: DataFrame, bucket: str, merged: dict[str, list[str]], threshold: float = 0.5
                 ) -> DataFrame:
    """Fired over total per bucket and for merged buckets, in one pass over the rows."""
    per = df.groupBy(F.col(bucket).alias("bucket")).agg(
        F.count_if(F.col("prob") >= threshold).alias("fired"), F.count(F.lit(1)).alias("total"))
    names = F.array_compact(F.array(F.col("bucket"), *[
        F.when(F.col("bucket").isin(members), name) for name, members in merged.items()]))
    out = per.select(F.explode(names).alias("bucket"), "fired", "total").groupBy("bucket").agg(
        F.sum("fired").alias("fired"), F.sum("total").alias("total"))
    return out.withColumn("rate", safe_div(F.col("fired"), F.col("total")))


def model_compare(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """accuracy, precision, recall, F1 and ROC area per model."""
    base = confusion(df, threshold, keys=["model"]).select(
        "model", "accuracy", "precision", "recall", "f1")
    return base.join(auc(score_points(df, keys=["model"]), ["model"]).select("model", "roc_auc"),
                     "model")


def pivot_recall(df: DataFrame, models: list[str], threshold: float = 0.5) -> DataFrame:
    rec = per_attack_recall(df, threshold, ["model"])
    return rec.groupBy("attack_type").pivot("model", models).agg(F.first("recall"))


def technique_coverage(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Technique catalogue with support and recall of what was detected."""
    catalogue = df.sparkSession.createDataFrame(
        K.TECHNIQUES, "scenario string, technique string, name string, tactic string")
    found = per_attack_recall(df, threshold).withColumnRenamed("attack_type", "scenario")
    return catalogue.join(found, "scenario", "left").withColumns({
        "support": F.coalesce("support", F.lit(0)),
        "covered": F.coalesce(F.col("recall") > 0, F.lit(False))})


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.avg(flag(F.col(a) == F.col(b))).alias("agreement"),
                  F.count(F.lit(1)).alias("rows"))


def density_split(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Attack windows with and without a distinctive token: count and detection rate."""
    marks = F.array(*[F.lit(t) for t in K.DISTINCT_TOKENS])
    return df.groupBy(F.arrays_overlap("tokens", marks).alias("distinctive")).agg(
        F.count(F.lit(1)).alias("windows"), F.min("prob").alias("min_prob"),
        F.avg("prob").alias("mean_prob"), F.max("prob").alias("max_prob"),
        F.avg(flag(F.col("prob") >= threshold)).alias("detected"))

