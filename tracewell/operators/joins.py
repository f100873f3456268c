"""Interval, lookup, semi/anti and alignment joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.scalars import safe_div
from tracewell.session import broadcast_if_small, small_side, written_table

# Bits by which a level's cells are wider than those of the level below; 16 levels span all times.
CELL_BITS = 4
LEVELS = 64 // CELL_BITS
# Cells (three longs each) up to which the interval index may be broadcast.
BROADCAST_CELLS = 1_000_000


def interval_index(spans: DataFrame) -> DataFrame:
    """``level``, ``cell``, ``pos``: per aligned cell the lowest ``pos`` of the intervals cut into it.

    An interval (both ends inclusive) is the disjoint union of the largest aligned cells of
    ``2 ** (CELL_BITS * level)`` microseconds inside it: at most 30 on each level, and on all but the
    highest ones only near its ends. Equal cells of different intervals become one row, since the
    first interval is a minimum.
    """
    far = F.lit(1 << 62)
    bounds = spans.where(F.col("end_us") >= F.col("start_us")).select(
        "pos", F.greatest(F.col("start_us"), -far).alias("_start"),
        (F.least(F.col("end_us"), far) + 1).alias("_after"),
        F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("level"))
    # First cell and the one after the last that lie inside, on a level and on the next higher one.
    bounds = bounds.selectExpr(
        "pos", "level", f"-shiftright(-_start, {CELL_BITS} * level) AS low",
        f"shiftright(_after, {CELL_BITS} * level) AS high",
        *[f"IF(level < {LEVELS - 1}, shiftleft({cell}, {CELL_BITS}), 0) AS {name}" for name, cell in (
            ("up_low", f"-shiftright(-_start, {CELL_BITS} * level + {CELL_BITS})"),
            ("up_high", f"shiftright(_after, {CELL_BITS} * level + {CELL_BITS})"))])
    run = "IF({0} < {1}, sequence({0}, {1} - 1), CAST(array() AS ARRAY<BIGINT>))"
    cells = F.expr(f"IF(up_low < up_high, concat({run.format('low', 'up_low')}, {run.format('up_high', 'high')}), "
                   f"{run.format('low', 'high')})")
    laid = bounds.select("pos", "level", F.explode(cells).alias("cell"))
    return laid.groupBy("level", "cell").agg(F.min("pos").alias("pos"))


def _cell(us: Column, level: int) -> Column:
    return F.shiftright(us, CELL_BITS * level)


def first_match_interval(
    events: DataFrame, spans: DataFrame, value: dict[str, Column], us: str = "us",
    *, applies: Column | None = None, broadcast_cells: int = BROADCAST_CELLS,
) -> DataFrame:
    """Left join of each event to the first interval (lowest ``pos``) with start <= time <= end.

    ``spans`` has ``start_us``, ``end_us`` and ``pos``. An event looks up its cell of ``interval_index``
    on each level that occurs and takes the lowest ``pos``; however many intervals overlap, a level
    gives one row. An index of at most ``broadcast_cells`` rows is looked up in place, without a shuffle of
    the events; a larger one is joined to the distinct times, which are then joined to the events.
    A null time is in no interval.
    """
    index = written_table(interval_index(spans), "cells")
    levels = sorted(r["level"] for r in index.select("level").distinct().collect())
    time = F.col(us).cast("bigint")
    if index.count() <= broadcast_cells:
        joined, found = events, []
        for level in levels:
            cells = index.where(F.col("level") == level).select(
                F.col("cell").alias("_cell"), F.col("pos").alias(f"_pos{level}"))
            joined = joined.join(F.broadcast(cells), _cell(time, level) == F.col("_cell"), "left").drop("_cell")
            found.append(F.col(f"_pos{level}"))
        first = F.least(*found) if len(found) > 1 else found[0] if found else F.lit(None).cast("bigint")
        joined = joined.withColumn("_first", first).drop(*[f"_pos{level}" for level in levels])
    else:
        times = events.select(time.alias("_time")).where("_time IS NOT NULL").distinct()
        asked = times.select("_time", F.explode(F.array(*[
            F.struct(F.lit(level).alias("level"), _cell(F.col("_time"), level).alias("cell"))
            for level in levels])).alias("_c")).select("_time", "_c.*")
        winners = asked.join(index, ["level", "cell"]).groupBy("_time").agg(F.min("pos").alias("_first"))
        joined = events.join(winners, time == F.col("_time"), "left").drop("_time")
    if applies is not None:
        joined = joined.withColumn("_first", F.when(applies, F.col("_first")))
    facts = spans.where(F.col("end_us") >= F.col("start_us")).select(
        F.col("pos").alias("_first"), *[c.alias(f"_f_{n}") for n, c in value.items()]).dropDuplicates(["_first"])
    joined = joined.join(small_side(facts), "_first", "left")
    return joined.select(*events.columns, *[F.col(f"_f_{n}").alias(n) for n in value])


def session_span(events: DataFrame, spans: DataFrame, mode: str = "exact", us: str = "us"
                 ) -> DataFrame:
    """Events inside a span, with its session; others are dropped."""
    if mode == "second":
        out = events.withColumn("_cut", F.floor(F.col(us) / 1_000_000) * 1_000_000)
        out = first_match_interval(out, spans, {"span_session": F.col("session")}, "_cut").drop("_cut")
    else:
        out = first_match_interval(events, spans, {"span_session": F.col("session")}, us)
    return out.where(F.col("span_session").isNotNull())


def attack_window(events: DataFrame, windows: DataFrame, user: str = "actor", us: str = "us"
                  ) -> DataFrame:
    """Label and attack type of the first window around the event; system users never match."""
    out = first_match_interval(
        events, windows, {"_type": F.col("attack_type"), "_pos": F.col("pos")}, us,
        applies=~F.col(user).startswith("system:"))
    return out.withColumns({
        "window_label": F.when(F.col("_pos").isNotNull(), 1).otherwise(0),
        "window_type": F.coalesce("_type", F.lit("")),
    }).drop("_type", "_pos")


def causal_relabel(df: DataFrame, user: Column, start: Column, end: Column, ts: str = "ts"
                   ) -> DataFrame:
    """One identity is an attacker inside the interval and benign outside."""
    inside = user & F.col(ts).between(start, end)
    return df.withColumn("label", F.when(F.coalesce(inside, F.lit(False)), 1).otherwise(0))


def pod_actor(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Actor behind a pod, else ``pod:<name>``, else ``unknown``."""
    fallback = F.when(F.col("pod") != "", F.concat(F.lit("pod:"), "pod")).otherwise("unknown")
    small = broadcast_if_small(mapping.select("pod", F.col("actor").alias("_actor")))
    return (df.join(small, "pod", "left")
            .withColumn("actor", F.coalesce("_actor", fallback)).drop("_actor"))


def vector_columns(df: DataFrame, features: list[str], digits: int = 4) -> DataFrame:
    """Rounded copies used for row equality."""
    return df.withColumns({f"_v{i}": F.bround(F.col(f).cast("double"), digits)
                           for i, f in enumerate(features)})


def vector_keys(features: list[str]) -> list[str]:
    return [f"_v{i}" for i in range(len(features))]


def leak_anti(train: DataFrame, held_out: DataFrame, features: list[str], label: str = "label"
              ) -> DataFrame:
    """Drop attack rows of train whose rounded vector equals a held-out attack vector.

    Held-out vectors are made distinct first, so repeats cost nothing in the join; benign rows
    skip it.
    """
    keys = vector_keys(features)
    bad = vector_columns(held_out.where(F.col(label) == 1), features).select(*keys).distinct()
    attacks = vector_columns(train.where(F.col(label) == 1), features)
    kept = attacks.join(bad, keys, "left_anti").select(*train.columns)
    return kept.unionByName(train.where(F.coalesce(F.col(label) != 1, F.lit(True))))


def novel_anti(evaluation: DataFrame, train: DataFrame, features: list[str], label: str = "label"
               ) -> DataFrame:
    """Evaluation rows whose vector never occurs among train attacks."""
    keys = vector_keys(features)
    seen = vector_columns(train.where(F.col(label) == 1), features).select(*keys).distinct()
    return (vector_columns(evaluation, features).join(seen, keys, "left_anti")
            .select(*evaluation.columns))


def overlap_rate(test: DataFrame, train: DataFrame, features: list[str]) -> DataFrame:
    """Share of test rows whose exact vector occurs in train."""
    keys = vector_keys(features)
    seen = vector_columns(train, features).select(*keys).distinct().withColumn("_seen", F.lit(1))
    counted = vector_columns(test, features).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    out = counted.join(seen, keys, "left").agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("test_rows"),
        F.coalesce(F.sum(F.when(F.col("_seen") == 1, F.col("_n"))), F.lit(0)).alias("dup_rows"))
    return out.withColumn("dup_rate", safe_div(F.col("dup_rows"), F.col("test_rows")))


def known_allow(df: DataFrame, user: str = "user", label: str = "label") -> DataFrame:
    """Allowlisted identities that were seen behaving benignly."""
    from tracewell.operators.normalize import allowed
    return df.where((F.col(label) == 0) & allowed(F.col(user))).select(user).distinct()


def heavy_hitter(df: DataFrame, top: DataFrame, key: str = "src_ip") -> DataFrame:
    """Flag rows whose source is in the top list. The list has at most k rows by construction."""
    marks = top.select(key).withColumn("is_heavy", F.lit(1))
    return df.join(broadcast_if_small(marks), key, "left").withColumn(
        "is_heavy", F.coalesce("is_heavy", F.lit(0)))


def align_rows(left: DataFrame, right: DataFrame, key: str = "row_id") -> DataFrame:
    """Join two prediction tables on the row id."""
    return left.join(right, key)


def alignment_report(left: DataFrame, right: DataFrame, key: str = "row_id", label: str = "label"
                     ) -> DataFrame:
    """Rows missing on one side and rows whose labels differ; all zero when aligned."""
    a = left.select(key, F.col(label).alias("_la"), F.lit(1).alias("_a"))
    b = right.select(key, F.col(label).alias("_lb"), F.lit(1).alias("_b"))
    return a.join(b, key, "full_outer").agg(
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("matched"),
        F.count_if(F.col("_b").isNull()).alias("left_only"),
        F.count_if(F.col("_a").isNull()).alias("right_only"),
        F.count_if(F.col("_la") != F.col("_lb")).alias("label_conflicts"))


def assert_aligned(left: DataFrame, right: DataFrame, key: str = "row_id", label: str = "label"
                   ) -> None:
    row = alignment_report(left, right, key, label).first()
    if row["left_only"] or row["right_only"] or row["label_conflicts"]:
        raise ValueError(f"prediction tables are not aligned: {row.asDict()}")


def actor_sets(truth: DataFrame, flagged: DataFrame, actor: str = "actor") -> DataFrame:
    """tp/fp/fn over two actor sets, with precision and recall rounded to four digits."""
    a = truth.select(actor).distinct().withColumn("_t", F.lit(1))
    b = flagged.select(actor).distinct().withColumn("_f", F.lit(1))
    out = a.join(b, actor, "full_outer").agg(
        F.count_if(F.col("_t").isNotNull() & F.col("_f").isNotNull()).alias("tp"),
        F.count_if(F.col("_t").isNull()).alias("fp"),
        F.count_if(F.col("_f").isNull()).alias("fn"))
    return out.withColumns({
        "precision": F.bround(F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)), 4),
        "recall": F.bround(F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1)), 4),
    })


def two_planes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Alerts of two planes in one table; grouping by actor and time follows, no pairwise join."""
    return a.unionByName(b, allowMissingColumns=True)
