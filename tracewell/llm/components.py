"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.session import remove_path, scratch_path


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    path = scratch_path(df.sparkSession, "edges")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node that it is linked to; nodes without edges are left out.

    ``edges`` has ``a`` and ``b``. Large-star and small-star steps take turns until each node hangs
    on its root. A step finds the least neighbour with a combined aggregate and joins it back, so no
    neighbourhood is collected. Each round's edges are written to the shared folder, and those of the
    round before are removed.
    """
    spark = edges.sparkSession
    down, before = _written(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = down.select("u", "v").unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where(F.col("v") > F.col("u")).join(least, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        large, middle = _written(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = (small.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        down, after = _written(small)
        remove_path(spark, before)
        remove_path(spark, middle)
        before = after
        hung = down.select(F.col("u").alias("v")).distinct()
        if down.join(hung, "v", "left_semi").isEmpty():
            # No parent is a child, and the small-star step left one parent to each child.
            return down.select(F.col("u").alias("node"), F.col("v").alias("root"))
