"""Episode-level rule detectors and rule baselines over feature windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import constants as K
from tracewell.functions.scalars import flag
from tracewell.operators.evaluate import score_points
from tracewell.operators.normalize import allowed

RULES = ["rule_f", "rule_recon", "rule_destruct", "rule_hijack", "rule_persist", "rule_anom"]


def signal_f() -> Column:
    c = F.col
    return ((c("has_crb") >= 1) | (c("has_exec") >= 1) | (c("has_impersonation") >= 1)
            | ((c("has_secret") >= 1) & (c("secret_ns") >= 2)))


def window_signals() -> dict[str, Column]:
    """Per-window condition of each rule, before the identity test."""
    c = F.col
    persist = (c("has_csr") >= 1) | (c("has_tokenreq") >= 1)
    recon = c("n_selfreview") >= K.RECON_REVIEWS
    destruct = c("n_delete") >= K.DESTRUCT_DELETES
    hijack = c("n_create_workload") >= K.HIJACK_WORKLOADS
    return {"rule_f": signal_f(), "rule_recon": recon, "rule_destruct": destruct,
            "rule_hijack": hijack, "rule_persist": persist,
            "rule_anom": destruct | recon | hijack | persist}


def episode_rules(windows: DataFrame, threshold: float = 0.5, k: int = K.HYSTERESIS_K
                  ) -> DataFrame:
    """One row per episode with every rule, the classifier and their union.

    Windows carry ``part, session, uid, user, label, prob`` and the features. Everything about
    windows is one map-side combined aggregation; identities are tested on the small result.
    """
    fired = F.col("prob") >= threshold
    novel = F.count_if(fired & F.col("novel")) if "novel" in windows.columns else F.lit(None).cast("bigint")
    # First per identity; whether an identity was ever seen behaving well is settled on that result.
    per = windows.groupBy("part", "session", "uid", "user").agg(
        F.max("label").alias("label"), F.count(F.lit(1)).alias("n_windows"),
        F.count_if(fired).alias("fired"), novel.alias("fired_novel"),
        F.bool_or(F.coalesce(F.col("label") == 0, F.lit(False))).alias("_good"),
        *[F.bool_or(cond).alias(name) for name, cond in window_signals().items()])
    per = per.withColumn("_known", F.bool_or("_good").over(Window.partitionBy("user")) & allowed(F.col("user")))
    eps = per.groupBy("part", "session", "uid").agg(
        F.min_by("_known", "user").alias("_known"), F.min("user").alias("user"),
        F.max("label").alias("label"), *[F.sum(c).alias(c) for c in ("n_windows", "fired", "fired_novel")],
        *[F.bool_or(name).alias(name) for name in window_signals()])
    free = ~allowed(F.col("user"))
    odd = (allowed(F.col("user")) & F.col("user").startswith("system:serviceaccount:") & ~F.col("_known"))
    eps = eps.withColumns({
        "clf": (F.col("fired") >= k) & free,
        "clf_novel": F.coalesce((F.col("fired_novel") >= k) & free, F.lit(False)),
        **{r: F.col(r) & (odd if r == "rule_anom" else free) for r in RULES},
    }).drop("_known")
    any_rule = F.lit(False)
    for r in RULES:
        any_rule = any_rule | F.col(r)
    return eps.withColumns({"rule_full": F.col("clf") | any_rule,
                            "full_novel": F.col("clf_novel") | any_rule})


def keyword_rule(tokens: str = "tokens", short: bool = False) -> Column:
    """Does the window hold a signature token?"""
    words = K.DISTINCT_TOKENS if short else K.SIGNATURE_TOKENS
    return F.arrays_overlap(F.col(tokens), F.array(*[F.lit(t) for t in words]))


REVIEW_FEATURES = ["n_selfreview", "selfreview_ratio"]


def best_single_threshold(df: DataFrame, features: list[str], positive: Column, negative: Column
                          ) -> DataFrame:
    """Per feature the threshold with the highest recall minus FPR; lowest on ties. One pass for all."""
    long = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("_x"))
                               for f in features])).alias("_f")
    rows = df.withColumn("_y", F.when(positive, 1).when(negative, 0)).where(
        F.col("_y").isNotNull()).select("_y", long).select("_y", "_f.*")
    pts = score_points(rows, "_x", "_y", ["feature"], bucket=F.floor(F.col("_x") * 1000))
    rec, fpr = F.col("tp") / F.col("pos"), F.col("fp") / F.col("neg")
    return pts.select("feature", "threshold", rec.alias("recall"),
                      fpr.alias("fpr"), (rec - fpr).alias("gain")).groupBy("feature").agg(
        F.max_by(F.struct("threshold", "recall", "fpr"),
                 F.struct("gain", -F.col("threshold"))).alias("_b")).select("feature", "_b.*")


def baseline_rates(df: DataFrame) -> DataFrame:
    """Recall and FPR of the model and of the presence, identity and identity-shape baselines."""
    recon = F.col("user").contains("recon-sa")
    benign = F.col("label") == 0
    preds = {"model": F.col("prob") >= 0.5, "presence": F.col("n_selfreview") >= 1,
             "identity": recon, "shape": F.col("user").startswith("system:serviceaccount")}
    aggs = []
    for name, p in preds.items():
        aggs += [F.avg(F.when(recon, flag(p))).alias(f"{name}_recall"),
                 F.avg(F.when(benign, flag(p))).alias(f"{name}_fpr")]
    reviewing = benign & preds["presence"]
    return df.agg(*aggs, F.avg(flag(preds["model"] == preds["presence"])).alias("agreement"),
                  F.avg(F.when(reviewing, flag(~preds["model"]))).alias("reviewers_spared"))


def leakage_gate(rates: DataFrame, singles: DataFrame) -> DataFrame:
    """PASS when the model beats presence and the best single feature and is no lookup of presence.

    Both tables are small: one row, and one row per feature.
    """
    best_recall = F.lit(singles.agg(F.max("recall")).first()[0])
    return rates.withColumn("best_single_recall", best_recall).withColumn("verdict", F.when(
        (F.col("model_fpr") < F.col("presence_fpr") - 0.03)
        & (F.col("model_recall") >= best_recall - 0.02)
        & (F.col("agreement") < 0.95), "PASS").otherwise("FAIL"))


def identity_only(df: DataFrame, actor: str = "actor", label: str = "label") -> DataFrame:
    """Predict each row's label from its actor's majority, rounding half to even."""
    per = df.groupBy(actor).agg(F.bround(F.avg(label), 0).cast("int").alias("pred"),
                                F.count(F.lit(1)).alias("rows"),
                                F.sum(label).alias("attacks"))
    hit = F.when(F.col("pred") == 1, F.col("attacks")).otherwise(F.col("rows") - F.col("attacks"))
    return per.withColumn("correct", hit)
