"""Monitoring rollups over a counter table ``(us, metric, label, value)``, with an optional ``seq``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINUTE_US = 60_000_000


def _last(df: DataFrame) -> Column:
    """The last value by time; samples of equal time are told apart by ``seq``, else by value."""
    return F.max_by("value", F.struct("us", "seq" if "seq" in df.columns else "value"))


def total(df: DataFrame, metric: str) -> DataFrame:
    """Sum of the last value of every series of a counter, 0 when there is none."""
    last = df.where(F.col("metric") == metric).groupBy("metric", "label").agg(
        _last(df).alias("v"))
    return last.agg(F.coalesce(F.sum("v"), F.lit(0)).alias("total"))


def increase(df: DataFrame, minutes: int = 1, labels: list[str] = ["metric", "label"]) -> DataFrame:
    """Counter increase per window. A drop counts as a restart from zero.

    The last value per series and window is found first, so the lag runs over one row per window.
    """
    width = minutes * MINUTE_US
    per = df.groupBy(*labels, F.floor(F.col("us") / width).alias("win")).agg(
        _last(df).alias("v"))
    prev = F.lag("v").over(Window.partitionBy(*labels).orderBy("win"))
    step = F.when(prev.isNull(), F.col("v")).when(F.col("v") < prev, F.col("v")).otherwise(
        F.col("v") - prev)
    return per.select(*labels, (F.col("win") * width).alias("win_us"), step.alias("increase"))


def rate_rule(df: DataFrame, severities: list[str], minutes: int = 1) -> DataFrame:
    """Windows in which a counter of the given severities rose."""
    inc = increase(df.where(F.col("label").isin(severities)), minutes)
    return inc.groupBy("win_us").agg(F.sum("increase").alias("increase")).where(
        F.col("increase") > 0)


def offset_rule(df: DataFrame, minutes: int = 1) -> DataFrame:
    """Sum over all series against the sum one window earlier, a missing one counting as 0."""
    width = minutes * MINUTE_US
    sums = df.groupBy(F.floor(F.col("us") / width).alias("win"), "metric", "label").agg(
        _last(df).alias("v")).groupBy("win").agg(F.sum("v").alias("now"))
    prev = sums.select((F.col("win") + 1).alias("win"), F.col("now").alias("before"))
    diff = F.col("now") - F.coalesce("before", F.lit(0))
    return sums.join(prev, "win", "left").select(
        (F.col("win") * width).alias("win_us"), "now", diff.alias("change")).where(diff > 0)


def suppress_repeats(df: DataFrame, name: str = "alertname", repeat_us: int = 30 * MINUTE_US
                     ) -> DataFrame:
    """Notifications of each alert name: one at the start, then one per repeat interval.

    A firing is notified when it is the first of its repeat slot counted from the start of its
    run; a run ends when the alert is silent for a whole interval. Runs are found on one row per
    name and repeat slot.
    """
    slot = F.floor(F.col("us") / repeat_us)
    per = df.groupBy(name, slot.alias("_slot")).agg(F.min("us").alias("_a"), F.max("us").alias("_b"))
    order = Window.partitionBy(name).orderBy("_slot")
    new = F.coalesce(F.col("_a") - F.lag("_b").over(order) > repeat_us, F.lit(True))
    per = per.withColumn("_new", new)
    runs = per.select(name, "_slot", F.last(F.when(F.col("_new"), F.col("_a")), True).over(
        order.rowsBetween(Window.unboundedPreceding, 0)).alias("run_us"))
    tick = F.floor((F.col("us") - F.col("run_us")) / repeat_us)
    return df.withColumn("_slot", slot).join(runs, [name, "_slot"]).groupBy(
        name, "run_us", tick.alias("tick")).agg(
        F.min("us").alias("notify_us"), F.count(F.lit(1)).alias("firings"))


def distinct_pods(df: DataFrame, pod: str = "pod") -> DataFrame:
    return df.agg(F.count_distinct(pod).alias("pods"))


def sum_by(df: DataFrame, *keys: str, value: Column | None = None) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(F.lit(1) if value is None else value).alias("total"))


def up(df: DataFrame, job: str = "job") -> DataFrame:
    """Least liveness per job."""
    return df.groupBy(job).agg(F.min("up").alias("up"))
