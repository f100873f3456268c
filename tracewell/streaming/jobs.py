"""Structured Streaming jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.scalars import severity_band
from tracewell.operators.windows import token_column

LATENESS = "15 minutes"


def stream_table(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None
                 ) -> DataFrame:
    """A parquet table of the folder as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def run_to_table(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Process what is there, append to a parquet table, and return the table."""
    query = (stream.writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", checkpoint).outputMode("append")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def run_batches(stream: DataFrame, process, checkpoint: str, poll: str | None = None):
    """Feed micro-batches to ``process(df, batch_id)``; ``poll`` keeps it running."""
    writer = stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    if poll:
        return writer.trigger(processingTime=poll).start()
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def dedup(stream: DataFrame, key: str = "audit_key", ts: str = "ts", lateness: str = LATENESS
          ) -> DataFrame:
    """Drop repeated ids within the lateness; rows without an id bypass the state and all pass."""
    named = F.coalesce(F.col(key), F.lit("")) != ""
    first = (stream.where(named).withWatermark(ts, lateness)
             .dropDuplicatesWithinWatermark([key]))
    return first.unionByName(stream.where(~named).withWatermark(ts, lateness))


def incident_sessions(stream: DataFrame, gap: str = "60 seconds", lateness: str = LATENESS,
                      ts: str = "ts") -> DataFrame:
    """Live incident grouping; an incident is emitted when the watermark passes its end.

    With ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` set for the session,
    a busy actor costs one row per partition and session in the shuffle.
    """
    return (stream.withWatermark(ts, lateness)
            .groupBy("actor", F.session_window(ts, gap).alias("w"))
            .agg(F.count(F.lit(1)).alias("n_alerts"), F.max("raw_score").alias("base_score"),
                 F.min("us").alias("start_us"), F.max("us").alias("end_us"),
                 F.count_if(F.col("hint") != "").alias("n_hints"))
            .select("actor", "start_us", "end_us", "n_alerts", "n_hints", "base_score"))


def counters(stream: DataFrame, metric: str, label: str, width: str = "1 minute",
             lateness: str = LATENESS, ts: str = "ts") -> DataFrame:
    """Counter increments per window and label."""
    return (stream.withWatermark(ts, lateness)
            .groupBy(F.window(ts, width).alias("w"), F.col(label).alias("label"))
            .agg(F.count(F.lit(1)).alias("value"))
            .select(F.lit(metric).alias("metric"), "label",
                    F.unix_micros("w.start").alias("win_us"), "value"))


def alert_records(scored: DataFrame, threshold: float = 0.5, last: int = 5) -> DataFrame:
    """Alert rows: actor, probability, severity and the last tokens, however few there are."""
    real = F.filter("tokens", lambda t: t != "<PAD>")
    return scored.where(F.col("prob") >= threshold).select(
        "audit_id", "actor", "prob", severity_band(F.col("prob")).alias("severity"),
        F.slice(real, F.greatest(F.size(real) - (last - 1), F.lit(1)), F.lit(last)).alias("last_tokens"))


def tokens(stream: DataFrame) -> DataFrame:
    """Token per event, system and blank users skipped."""
    return stream.where((F.col("actor") != "") & ~F.col("actor").startswith("system:")).withColumn(
        "token", token_column())
