"""Session helpers: builder for local runs, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows up to which a lookup table whose size was counted may be broadcast.
BROADCAST_ROWS = 200_000


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tracewell")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    Only where ``spark.checkpoint.dir`` is unset (local tests) is a temporary folder made.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and spark.sparkContext.getCheckpointDir():
        return spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        base = tempfile.mkdtemp(prefix="tracewell-")
    spark.sparkContext.setCheckpointDir(base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _store(spark: SparkSession, path: str):
    """The store that a path of ours lies in, and the path there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def list_paths(spark: SparkSession, pattern: str) -> list[str]:
    store, target = _store(spark, pattern)
    return [f.getPath().toString() for f in store.globStatus(target) or []]


def make_folder(spark: SparkSession, path: str) -> None:
    store, target = _store(spark, path)
    store.mkdirs(target)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours; nothing happens if it isn't there."""
    store, target = _store(spark, path)
    store.delete(target, True)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage through a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written_table(df: DataFrame, name: str = "table") -> DataFrame:
    """Write to the shared folder and read back, for a table that several branches use.

    Unlike a checkpoint the result is columnar: each branch reads only its columns and filters.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting; otherwise leave the join to a shuffle."""
    rows = df.limit(limit + 1).count()
    return F.broadcast(df) if rows <= limit else df


def small_side(df: DataFrame) -> DataFrame:
    """A join side expected to be small: computed once, then broadcast if its size allows."""
    return broadcast_if_small(materialize(df))
