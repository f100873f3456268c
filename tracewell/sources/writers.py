"""Sinks. All of them write in parallel from the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions import constants as K


def write_features(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Feature table in label, features, user, tool, session order."""
    out = df.select("label", *K.ALL_FEATURES, "user", "tool", "session")
    writer = out.write.mode("errorifexists")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)


def write_splits(df: DataFrame, path: str, split: str = "split", label: str = "label") -> DataFrame:
    """Tables partitioned by split, plus a summary row per split and label as JSON."""
    df.write.partitionBy(split).parquet(f"{path}/data")
    back = df.sparkSession.read.parquet(f"{path}/data")
    back.groupBy(split, label).agg(F.count(F.lit(1)).alias("rows")).write.json(f"{path}/summary")
    return back


def write_predictions(df: DataFrame, path: str) -> None:
    df.write.parquet(f"{path}/predictions")


def write_tokens(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_curves(roc: DataFrame, pr: DataFrame, path: str) -> None:
    roc.write.parquet(f"{path}/roc")
    pr.write.parquet(f"{path}/pr")


def write_incidents(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_alert_stream(alerts: DataFrame, path: str, checkpoint: str, webhook=None) -> None:
    """Append the alerts of a stream as JSON lines, each row once; processes what is there.

    ``webhook`` is an optional per-partition callback for live notification, off by default. It runs in a
    query of its own (with its own checkpoint), so a slow receiver doesn't hold up the file.
    """
    queries = [alerts.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint)
               .outputMode("append").trigger(availableNow=True).start()]
    if webhook is not None:
        queries.append(alerts.writeStream.foreachBatch(lambda df, _: df.foreachPartition(webhook)).option(
            "checkpointLocation", f"{checkpoint}-webhook").trigger(availableNow=True).start())
    for q in queries:
        q.awaitTermination()
