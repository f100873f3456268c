"""Episode, balance, profile and interval aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import constants as K
from tracewell.functions.scalars import safe_div, wilson_lb
from tracewell.operators.partition import exact_quantiles, unit_bucket

EPISODE = ["part", "session", "uid"]


def count_by(df: DataFrame, *keys: str, name: str = "rows") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def class_balance(df: DataFrame, label: str, binary: Column) -> DataFrame:
    """Rows per raw label with share, plus the binary balance and its verdict."""
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"), F.max(binary).alias("_y"))
    # One row per distinct label from here on.
    whole = Window.partitionBy(F.lit(0))
    benign = F.sum(F.when(F.col("_y") == 0, F.col("rows")).otherwise(0)).over(whole)
    attack = F.sum(F.when(F.col("_y") == 1, F.col("rows")).otherwise(0)).over(whole)
    per = per.withColumns({"benign": benign, "attack": attack})
    per = per.withColumn("minority_ratio", safe_div(
        F.least("benign", "attack"), F.greatest("benign", "attack")))
    verdict = F.lit(K.BALANCE_FLOOR)
    for low, name in reversed(K.BALANCE_BANDS):
        verdict = F.when(F.col("minority_ratio") >= low, name).otherwise(verdict)
    return per.withColumns({
        "percent": 100.0 * F.col("rows") / (F.col("benign") + F.col("attack")),
        "verdict": verdict}).drop("_y")


def top_actors(df: DataFrame, n: int) -> DataFrame:
    return count_by(df, "actor", name="events").orderBy(F.desc("events"), "actor").limit(n)


def episode_top_calls(df: DataFrame, k: int = 8) -> DataFrame:
    """Most frequent (verb, resource, decision) per episode with the episode's signal counts."""
    calls = df.groupBy("session", "actor", "verb", "resource", "decision").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(F.col("sub") == "exec").alias("_exec"))
    # Call combinations per episode, not events, reach the window.
    ep = Window.partitionBy("session", "actor")
    ranked = calls.withColumns({
        "rank": F.row_number().over(ep.orderBy(F.desc("calls"), "verb", "resource", "decision")),
        "n_forbid": F.sum(F.when(F.col("decision") == "forbid", F.col("calls")).otherwise(0)).over(ep),
        "n_secrets": F.sum(F.when(F.col("resource") == "secrets", F.col("calls")).otherwise(0)).over(ep),
        "n_exec": F.sum("_exec").over(ep),
        "n_rbac": F.sum(F.when(F.col("resource").isin(K.RBAC_RESOURCES), F.col("calls"))
                        .otherwise(0)).over(ep),
    })
    return ranked.where(F.col("rank") <= k).drop("_exec")


def episodes(windows: DataFrame, threshold: float = 0.5, keys: list[str] = EPISODE) -> DataFrame:
    """Windows collapsed to episodes."""
    return windows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.count_if(F.col("prob") >= threshold).alias("fired"),
        F.max("prob").alias("max_prob"), F.avg("prob").alias("mean_prob"),
        F.max("label").alias("label"),
        F.bool_or(F.col("has_secret") == 1).alias("any_secret"),
        F.bool_or(F.col("has_exec") == 1).alias("any_exec"),
        F.bool_or(F.col("has_crb") == 1).alias("any_crb"))


def hysteresis(eps: DataFrame, k: int = K.HYSTERESIS_K) -> DataFrame:
    return eps.withColumn("alert", F.col("fired") >= k)


def hysteresis_sweep(eps: DataFrame, ks: tuple[int, ...] = (1, 2, 3, 5, 10)) -> DataFrame:
    """Recall and FPR per K, from conditional counts over one pass of the episodes."""
    aggs = []
    for k in ks:
        aggs += [F.count_if((F.col("label") == 1) & (F.col("fired") >= k)).alias(f"tp{k}"),
                 F.count_if((F.col("label") == 0) & (F.col("fired") >= k)).alias(f"fp{k}")]
    one = eps.agg(F.count_if(F.col("label") == 1).alias("attacks"),
                  F.count_if(F.col("label") == 0).alias("benign"), *aggs)
    rows = F.explode(F.array(*[F.struct(
        F.lit(k).alias("k"), F.col(f"tp{k}").alias("tp"), F.col(f"fp{k}").alias("fp")) for k in ks]))
    return one.select("attacks", "benign", rows.alias("_r")).select(
        "_r.k", safe_div(F.col("_r.tp"), F.col("attacks")).alias("recall"),
        safe_div(F.col("_r.fp"), F.col("benign")).alias("fpr"))


def detect_by_actor(eps: DataFrame) -> DataFrame:
    out = eps.where(F.col("label") == 1).groupBy("uid").agg(
        F.count_if(F.col("fired") >= 1).alias("caught_k1"),
        F.count_if(F.col("fired") >= 2).alias("caught_k2"),
        F.count(F.lit(1)).alias("episodes"))
    return out.withColumns({"recall_k1": safe_div(F.col("caught_k1"), F.col("episodes")),
                            "recall_k2": safe_div(F.col("caught_k2"), F.col("episodes"))})


def trajectory_signature(windows: DataFrame, features: list[str], keys: list[str] = EPISODE,
                         order: list[str] = ["us", "audit_id"]) -> DataFrame:
    """One signature per episode over its ordered vectors, without gathering the episode.

    Each row hashes (position, vector); order-free sums of two independent hashes and the length
    then identify the sequence. Positions come from chunked row numbers, so one very long episode
    is spread over many tasks.
    """
    from tracewell.operators.partition import split_hot_groups

    counted = split_hot_groups(windows, keys, totals={"rows": F.lit(True)})
    w = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    pos = F.row_number().over(w) + F.col("_base_rows")
    vec = [F.bround(F.col(f).cast("double"), 4) for f in features]
    rows = counted.withColumn("_pos", pos).withColumns({
        "_h1": F.xxhash64(F.lit(1), F.col("_pos"), *vec),
        "_h2": F.xxhash64(F.lit(2), F.col("_pos"), *vec)})
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), total("_h1").alias("_s1"), total("_h2").alias("_s2")
    ).select(*keys, F.sha2(F.concat_ws(":", F.col("_n").cast("string"), F.col("_s1").cast("string"),
                                       F.col("_s2").cast("string")), 256).alias("signature"))


def distinct_trajectories(eps: DataFrame, category: str = "category") -> DataFrame:
    """One episode per category and signature: the first in key order."""
    rest = [c for c in eps.columns if c not in (category, "signature")]
    first = F.min_by(F.struct(*rest), F.struct(*EPISODE))
    return (eps.groupBy(category, "signature").agg(first.alias("_e"))
            .select(category, "signature", "_e.*"))


def rule_matrix(eps: DataFrame, rules: list[str], category: str = "category") -> DataFrame:
    """Detected and total per category and rule, one row per pair."""
    one = eps.groupBy(category).agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(r)).alias(r) for r in rules])
    return one.unpivot([category, "total"], rules, "rule", "detected").withColumns({
        "rate": safe_div(F.col("detected"), F.col("total")),
        "wilson_lb": wilson_lb(F.col("detected"), F.col("total"))})


def component_delta(eps: DataFrame, category: str = "category") -> DataFrame:
    """Detection of the model alone and with each added component, and the gain in points."""
    cols = {
        "model_k1": F.col("fired") >= 1, "model_k2": F.col("fired") >= 2,
        "plus_f": (F.col("fired") >= 2) | F.col("rule_f"),
        "plus_recon": (F.col("fired") >= 2) | F.col("rule_recon"),
        "full": (F.col("fired") >= 2) | F.col("rule_f") | F.col("rule_recon")}
    out = eps.groupBy(category).agg(
        F.count(F.lit(1)).alias("episodes"), *[F.count_if(c).alias(n) for n, c in cols.items()])
    return out.withColumn("gain_points", 100.0 * (F.col("full") - F.col("model_k2"))
                          / F.col("episodes"))


def bootstrap_ci(groups: DataFrame, key: str, hits: str, total: str, resamples: int = 2000,
                 seed: int = 42, slices: int = 64) -> DataFrame:
    """95 % interval of hits/total per key, from resampled counts.

    For 0/1 data only (hits, total) matter: each resample draws the number of hits from a
    binomial, so the work is keys x resamples whatever the row count. Draws are made per
    (key, slice) from a seed derived from both, so a lost task repeats the same numbers.
    """
    import numpy as np
    import pandas as pd

    per = -(-resamples // slices)
    schema = f"{key} string, b int, stat double"

    def draw(batches):
        for pdf in batches:
            for k, h, n, s in pdf[["_key", "_hits", "_total", "_slice"]].itertuples(index=False):
                first, last = int(s) * per, min((int(s) + 1) * per, resamples)
                if last <= first or n == 0:
                    continue
                rng = np.random.default_rng([seed, int(s), abs(hash_text(k))])
                got = rng.binomial(int(n), h / n, size=last - first) / n
                yield pd.DataFrame({key: k, "b": range(first, last), "stat": got})

    def hash_text(value) -> int:
        import zlib
        return zlib.crc32(str(value).encode())

    tasks = groups.select(F.col(key).cast("string").alias("_key"), F.col(hits).alias("_hits"),
                          F.col(total).alias("_total"),
                          F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("_slice"))
    stats = tasks.mapInPandas(draw, schema)
    # The fractions are k/n with n fixed per key, at most ``resamples`` distinct values.
    return stats.groupBy(key).agg(
        F.percentile("stat", F.lit(0.025)).alias("low"),
        F.percentile("stat", F.lit(0.975)).alias("high"), F.count(F.lit(1)).alias("resamples"))


def feature_profile(df: DataFrame, group: str, features: list[str]) -> DataFrame:
    """Mean, minimum and maximum of features per group."""
    aggs = []
    for f in features:
        aggs += [F.avg(f).alias(f"{f}_mean"), F.min(f).cast("double").alias(f"{f}_min"),
                 F.max(f).cast("double").alias(f"{f}_max")]
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("rows"), *aggs)


def feature_quantiles(df: DataFrame, group: str, feature: str, bucket: Column,
                      probs: dict[str, float]) -> DataFrame:
    """Exact median and upper quantiles per group."""
    return exact_quantiles(df, feature, probs, bucket, [group])


def false_positives(windows: DataFrame, threshold: float = 0.5, k: int = K.HYSTERESIS_K
                    ) -> DataFrame:
    """Benign identities whose episodes alarm, with fired windows and on-deletion counts."""
    fired = F.col("prob") >= threshold
    deleting = F.col("n_delete") >= 3
    eps = windows.where(F.col("label") == 0).groupBy("session", "user").agg(
        F.count_if(fired).alias("fired"), F.count(F.lit(1)).alias("windows"),
        F.count_if(fired & deleting).alias("fired_del"), F.count_if(deleting).alias("del"))
    return eps.groupBy("user").agg(
        F.count_if(F.col("fired") >= k).alias("fp_episodes"), F.count(F.lit(1)).alias("episodes"),
        F.sum("fired").alias("fp_windows"), F.sum("windows").alias("windows"),
        F.sum("fired_del").alias("fp_delete_windows"), F.sum("del").alias("delete_windows"))


def band_overlap(df: DataFrame, low: int = 6, high: int = 15) -> DataFrame:
    """Do recon windows and benign self-review windows share the middle band?"""
    band = F.col("n_selfreview").between(low, high)
    recon = F.col("user").contains("recon-sa")
    benign = (F.col("label") == 0) & (F.col("n_selfreview") >= 1)
    out = df.agg(F.count_if(band & recon).alias("recon_in_band"),
                 F.count_if(band & benign).alias("benign_in_band"),
                 F.count_if(recon).alias("recon"), F.count_if(benign).alias("benign_reviews"))
    return out.withColumn("overlap", (F.col("recon_in_band") > 0) & (F.col("benign_in_band") > 0))


def window_eval(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    return df.groupBy("actor").agg(
        F.count(F.lit(1)).alias("windows"),
        F.count_if(F.col("prob") >= threshold).alias("flagged"),
        F.min("prob").alias("min_prob"), F.avg("prob").alias("mean_prob"),
        F.max("prob").alias("max_prob"))


def unknown_tokens(df: DataFrame, vocab: DataFrame) -> DataFrame:
    """Tokens absent from the vocabulary, with the rows they occur in."""
    seen = (df.select(F.explode(F.array_distinct("tokens")).alias("token"))
            .groupBy("token").agg(F.count(F.lit(1)).alias("windows")))
    return seen.where(F.col("token") != "<PAD>").join(vocab.select("token"), "token", "left_anti")


def diversity(df: DataFrame, features: list[str], group: str = "label") -> DataFrame:
    """Distinct vectors over all rows per class, as two plain aggregations."""
    vec = df.select(group, *[F.bround(F.col(f).cast("double"), 4).alias(f) for f in features])
    per = vec.groupBy(group, *features).agg(F.count(F.lit(1)).alias("_n"))
    out = per.groupBy(group).agg(F.count(F.lit(1)).alias("distinct_vectors"),
                                 F.sum("_n").alias("windows"))
    return out.withColumn("diversity", F.col("distinct_vectors") / F.col("windows"))


def score_quantile(df: DataFrame, probs: dict[str, float], keys: list[str]) -> DataFrame:
    return exact_quantiles(df, "prob", probs, unit_bucket(F.col("prob")), keys)
