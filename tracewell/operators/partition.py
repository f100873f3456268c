"""Skew-safe building blocks for ordered work.

A plain ``Window.partitionBy(actor)`` hands one actor's whole history to one task. The helpers
here cut a heavy group into chunks that keep the order, copy the few rows a look-back needs into
the next chunk, and carry running totals across chunks, so no task holds more than a chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.session import broadcast_if_small, materialize, written_table

CHUNK_ROWS = 1_000_000
BUCKET_US = 60_000_000


def split_hot_groups(
    df: DataFrame,
    keys: list[str],
    us: str = "us",
    *,
    halo_rows: int = 0,
    halo_us: int = 0,
    totals: dict[str, Column] | None = None,
    chunk_rows: int = CHUNK_ROWS,
    bucket_us: int = BUCKET_US,
) -> DataFrame:
    """Add ``_chunk``, ``_halo`` and ``_base_<total>`` so windows can run per (keys, _chunk).

    Groups of at most ``chunk_rows`` rows stay whole in chunk 0. Larger ones are cut at time
    buckets; rows of a bucket that a later chunk must see (the last ``halo_rows`` rows or the last
    ``halo_us`` microseconds before it) are repeated there with ``_halo`` set, to be dropped after
    the window. ``_base_<total>`` is the sum over all earlier chunks of the group.
    """
    totals = totals or {}
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > chunk_rows)
    if hot.isEmpty():
        plain = {"_chunk": F.lit(0).cast("bigint"), "_halo": F.lit(False)}
        plain.update({f"_base_{t}": F.lit(0).cast("bigint") for t in totals})
        return df.withColumns(plain)

    hot = broadcast_if_small(hot.select(*keys))
    bucket = F.floor(F.col(us) / bucket_us).cast("bigint")
    tagged = df.withColumn("_bucket", bucket)
    sums = [F.sum(F.when(c, 1).otherwise(0)).alias(f"_sum_{t}") for t, c in totals.items()]
    per = (tagged.join(hot, keys, "left_semi").groupBy(*keys, "_bucket")
           .agg(F.count(F.lit(1)).alias("_n"), F.min(us).alias("_first"), F.max(us).alias("_last"),
                *sums))
    # One row per (group, time bucket): bounded by the time span, not by the row count.
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    per = per.withColumns({
        "_off": F.coalesce(F.sum("_n").over(before), F.lit(0)),
        **{f"_run_{t}": F.coalesce(F.sum(f"_sum_{t}").over(before), F.lit(0)) for t in totals},
    }).withColumn("_chunk", F.floor(F.col("_off") / chunk_rows))
    per = materialize(per)

    most = halo_rows + halo_us // bucket_us + 1
    after = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(1, most)
    chunks = (per.groupBy(*keys, "_chunk")
              .agg(F.min("_off").alias("_c_off"), F.min("_first").alias("_c_first"),
                   *[F.min(f"_run_{t}").alias(f"_base_{t}") for t in totals])
              .withColumn("_next", F.collect_list(F.struct(
                  "_chunk", "_c_off", "_c_first",
                  *[f"_base_{t}" for t in totals])).over(after)))
    base_fields = [f"_base_{t}" for t in totals]
    lookup = per.join(chunks, [*keys, "_chunk"]).select(
        *keys, "_bucket",
        F.concat(
            F.array(F.struct(F.col("_chunk"), F.lit(False).alias("_halo"),
                             *[F.col(b) for b in base_fields])),
            F.transform(
                F.filter("_next", lambda c: (
                    (c["_c_off"] - (F.col("_off") + F.col("_n")) < halo_rows)
                    | ((c["_c_first"] - F.col("_last") <= halo_us) & F.lit(halo_us > 0)))),
                lambda c: F.struct(c["_chunk"].alias("_chunk"), F.lit(True).alias("_halo"),
                                   *[c[b].alias(b) for b in base_fields])),
        ).alias("_targets"))
    alone = F.array(F.struct(F.lit(0).cast("bigint").alias("_chunk"), F.lit(False).alias("_halo"),
                             *[F.lit(0).cast("bigint").alias(b) for b in base_fields]))
    out = (tagged.join(broadcast_if_small(lookup), [*keys, "_bucket"], "left")
           .withColumn("_t", F.explode(F.coalesce("_targets", alone))))
    return out.select(*df.columns, "_t.*")


def _prefix_sums(per: DataFrame, keys: list[str], levels: list[str], totals) -> DataFrame:
    """Sums of everything before each bucket, level by level, plus the group's whole sum."""
    parents = [*keys, *levels[:-1]]
    whole = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    before = whole.orderBy(levels[-1]).rowsBetween(Window.unboundedPreceding, -1)
    out = per.select(
        *keys, *levels,
        *[F.coalesce(F.sum(f"_s_{t}").over(before), F.lit(0)).alias(f"_base_{t}") for t in totals],
        *[F.sum(f"_s_{t}").over(whole).alias(f"{t}_all") for t in totals])
    if len(levels) == 1:
        return out
    up = per.groupBy(*parents).agg(*[F.sum(f"_s_{t}").alias(f"_s_{t}") for t in totals])
    up = _prefix_sums(up, keys, levels[:-1], totals).withColumnsRenamed(
        {f"_base_{t}": f"_up_{t}" for t in totals})
    return out.drop(*[f"{t}_all" for t in totals]).join(up, parents).select(
        *keys, *levels, *[f"{t}_all" for t in totals],
        *[(F.col(f"_base_{t}") + F.col(f"_up_{t}")).alias(f"_base_{t}") for t in totals])


def running_totals(
    df: DataFrame,
    order: list[Column],
    bucket: Column | list[Column],
    totals: dict[str, Column],
    keys: list[str] | None = None,
) -> DataFrame:
    """Running sums over a global (or per-key) order without one task seeing it all.

    ``bucket`` must rise with the order; a list gives nested levels, coarse to fine. Rows are
    summed per bucket, the bucket table gets prefix sums, and the remaining running sum is taken
    inside each bucket. Adds ``<total>`` (inclusive) and ``<total>_all`` (the whole group).
    """
    keys = keys or []
    buckets = bucket if isinstance(bucket, list) else [bucket]
    levels = [f"_b{i}" for i in range(len(buckets))]
    tagged = df.withColumns(dict(zip(levels, buckets)))
    per = tagged.groupBy(*keys, *levels).agg(
        *[F.sum(c).alias(f"_s_{t}") for t, c in totals.items()])
    base = _prefix_sums(per, keys, levels, totals)
    inside = Window.partitionBy(*keys, *levels).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    out = tagged.join(base, [*keys, *levels]).withColumns(
        {t: F.sum(c).over(inside) + F.col(f"_base_{t}") for t, c in totals.items()})
    return out.drop(*levels, *[f"_base_{t}" for t in totals])


def range_totals(df: DataFrame, order: list[Column], totals: dict[str, Column]) -> DataFrame:
    """Running sums over a global order, whatever the values look like.

    The rows are dealt out by sampled range borders and written once; the sums of whole partitions
    (one row per partition) give each partition its base. No partition is crowded as long as
    ``order`` ends in columns that tell equal values apart. Adds ``<total>`` (inclusive).
    """
    ranged = written_table(
        df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    per = ranged.groupBy("_part").agg(*[F.sum(c).alias(f"_s_{t}") for t, c in totals.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("_part", *[F.coalesce(F.sum(f"_s_{t}").over(before), F.lit(0)).alias(
        f"_base_{t}") for t in totals])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    out = ranged.join(F.broadcast(base), "_part").withColumns(
        {t: F.sum(c).over(inside) + F.col(f"_base_{t}") for t, c in totals.items()})
    return out.drop("_part", *[f"_base_{t}" for t in totals])


def unit_bucket(score: Column, buckets: int = 65536) -> Column:
    """Bucket of a score in [0, 1], even in log-odds.

    Detector scores crowd near 0 and 1, where equal steps would put most of them into two
    buckets. The bucket table has at most ``buckets`` + 1 rows per key.
    """
    span = 40.0
    odds = F.when(score <= 0, -span).when(score >= 1, span).otherwise(
        F.least(F.greatest(F.log(score / (1 - score)), F.lit(-span)), F.lit(span)))
    return F.floor((odds + span) / (2 * span) * buckets).cast("bigint")


def draw_key(cols: list[str], seed: int = 42) -> Column:
    """A repeatable pseudo-random order key: hex text that any engine computes alike."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def draw_number(key: Column, digits: int = 8) -> Column:
    """The key's first hex digits as a number, which rises with the key."""
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("bigint")


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: dict[str, float],
    bucket: Column,
    keys: list[str] | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles per key, from counted values and prefix sums."""
    keys = keys or []
    counted = (df.where(F.col(value).isNotNull()).groupBy(*keys, value)
               .agg(F.count(F.lit(1)).alias("_c")))
    cum = running_totals(counted, [F.col(value)], bucket, {"_cum": F.col("_c")}, keys)
    aggs = []
    for name, p in probs.items():
        rank = (F.col("_cum_all") - 1) * F.lit(float(p))
        low = F.min(F.when(F.col("_cum") > F.floor(rank), F.col(value)))
        high = F.min(F.when(F.col("_cum") > F.ceil(rank), F.col(value)))
        frac = F.max(rank - F.floor(rank))
        aggs.append((low + (high - low) * frac).alias(name))
    return cum.groupBy(*keys).agg(*aggs)
