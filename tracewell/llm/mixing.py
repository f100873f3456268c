"""Mixing sources to target weights by weighted fair queueing, in column functions only.

Every source gets a target number of words. Its documents, shuffled by a hash, are served in that
order, round after round; a copy's virtual finish time is the words that its source has served so
far, divided by the source's target. All copies are then sorted by finish time and the sorted list
is cut where the total budget is reached. So all sources are served at speeds in proportion to
their targets, and each stops within about one document of its target.

Defined results: rows equal in id, source and size are served one after the other, each on its own; a
null source is a source (the last); a null id sorts first among equal hashes; documents without
words take nothing; an empty table, or one without words, gives targets of 0. Equal finish times are
ordered by source, round, hash and repeat, so reruns agree.

Only ids, sources and sizes are shuffled, repeats as a count. A source, or a repeated row, may hold any
share of the rows: the two orders are cut at sampled range borders (``range_totals``), not by source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.words import word_count
from tracewell.operators.partition import range_totals
from tracewell.session import broadcast_if_small, written_table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
# Repeats of one row that a task numbers at a time.
REPEATS = 100_000


def shuffle_key(doc_id: Column) -> Column:
    """A fixed random order of the documents."""
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))


def source_targets(units: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST
                   ) -> DataFrame:
    """``source``, ``source_size``, ``place``, ``start`` (words of earlier sources), ``target``.

    ``units`` has ``source``, ``size`` and ``n`` (rows). Targets share the budget by weight; a
    source whose share exceeds ``most`` times its size is held there, and what is left is shared
    again among the others, until none exceeds it.
    """
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    ranked = range_totals(sizes, [F.col("source").asc_nulls_last()],
                          {"place": F.lit(1), "until": F.col("source_size")})
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]),
                          ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    sources = written_table(ranked.select(
        "source", "source_size", "place", (F.col("until") - F.col("source_size")).alias("start"),
        weight.cast("double").alias("weight"),
        (F.col("source_size") * most).alias("ceiling")), "sources")
    budget = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    per_weight = 0.0
    while True:
        # One small pass per round of sharing; the set of held sources only grows.
        held = F.col("weight") * F.lit(per_weight) > F.col("ceiling")
        row = sources.agg(F.sum(F.when(held, F.col("ceiling"))).alias("full"),
                          F.sum(F.when(~held, F.col("weight"))).alias("open")).first()
        nxt = (budget - (row["full"] or 0)) / row["open"] if row["open"] else per_weight
        if nxt <= per_weight:
            break
        per_weight = nxt
    share_of = F.col("weight") * F.lit(per_weight)
    return sources.select(
        "source", "source_size", "place", "start",
        F.when(share_of > F.col("ceiling"), F.col("ceiling").cast("double")).otherwise(share_of)
        .alias("target"))


def one_by_one(units: DataFrame) -> DataFrame:
    """Each unit ``n`` times, numbered from 1 in ``repeat``; units with many repeats go to several tasks."""
    few = F.col("n") <= REPEATS
    blocks = units.where(~few).select("*", F.explode(F.sequence(
        F.lit(0), F.expr(f"(n - 1) DIV {REPEATS}").cast("int"))).alias("_block"))
    blocks = blocks.repartition(F.xxhash64(*units.columns, "_block"))
    blocks = units.where(few).withColumn("_block", F.lit(0)).unionByName(blocks)
    first = F.col("_block").cast("bigint") * REPEATS
    return blocks.select(*units.columns, F.explode(F.sequence(
        first + 1, F.least(F.col("n"), first + REPEATS))).alias("repeat"))


def served_units(docs: DataFrame, doc_id: str, source: str, size: Column, weights=WEIGHTS,
                 share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per (``doc_id``, ``source``, ``size``): ``n`` rows, ``source_size``, ``target``; each row is
    taken ``each`` times and ``more`` of them once more, where the cut falls between repeats.
    """
    units = written_table(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
                    size.cast("bigint").alias("size"))
        .groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")), "units")
    sources = broadcast_if_small(source_targets(units, weights, share, most))
    placed = units.join(sources, units["source"].eqNullSafe(sources["source"])).drop(
        sources["source"])
    served = range_totals(
        one_by_one(placed.where(F.col("size") > 0)).withColumn("key", shuffle_key(F.col("doc_id"))),
        [F.col("place"), F.col("key"), F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("repeat")],
        {"until": F.col("size")})
    copies = (
        served.select("*", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("round"))
        .withColumn("finish", (F.col("round") * F.col("source_size") + F.col("until")
                               - F.col("start")) / F.col("target")))
    budget = sources.agg(F.sum("target")).first()[0] or 0.0
    queue = range_totals(
        copies.select("doc_id", "source", "size", "repeat", "place", "round", "key", "finish"),
        [F.col("finish"), F.col("place"), F.col("round"), F.col("key"),
         F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("repeat")], {"total": F.col("size")})
    taken = (queue.where(F.col("total") <= F.lit(budget)).groupBy("doc_id", "source", "size")
             .agg(F.count(F.lit(1)).alias("times")))
    same = [placed[c].eqNullSafe(taken[c]) for c in ("doc_id", "source", "size")]
    # A source's queue starts a round only after the one before, so repeats differ by one copy at most.
    return placed.join(taken, same[0] & same[1] & same[2], "left").select(
        placed["doc_id"], placed["source"], placed["size"], "n", "source_size", "target",
        F.expr("coalesce(times, 0L) DIV n").alias("each"), F.expr("coalesce(times, 0L) % n").alias("more"))


def mix(docs: DataFrame, doc_id: str, source: str, size: Column, **kw) -> DataFrame:
    """One row per (``doc_id``, ``source``, ``size``, ``copies``): ``n`` rows, ``source_size``, ``target``,
    ``copies`` taken of each row and ``taken`` words of each row."""
    parts = F.array(F.struct(F.col("more").alias("n"), (F.col("each") + 1).alias("copies")),
                    F.struct((F.col("n") - F.col("more")).alias("n"), F.col("each").alias("copies")))
    return served_units(docs, doc_id, source, size, **kw).select(
        "doc_id", "source", "size", "source_size", "target",
        F.inline(F.filter(parts, lambda x: x["n"] > 0))).withColumn("taken", F.col("size") * F.col("copies"))


def take_mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text",
             **kw) -> DataFrame:
    """The documents that the mix takes, with all their columns and ``copies``, how often each goes in."""
    units = served_units(docs, doc_id, source, word_count(F.col(text)), **kw)
    taken = written_table(units.where(F.col("each") + F.col("more") > 0).select(
        F.struct("doc_id", "source", "size").alias("key"), "each", "more"), "taken")
    rows = docs.select(F.struct("*").alias("row"), F.struct(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
        word_count(F.col(text)).alias("size")).alias("key"))
    columns = [*[F.col(f"row.`{c}`") for c in docs.columns if c != "copies"], "copies"]
    alike = taken.where(F.col("more") == 0).withColumnRenamed("each", "copies")
    kept = rows.join(alike, rows["key"].eqNullSafe(alike["key"])).select(*columns)
    # Repeated rows that the cut falls between, a row of ``taken`` per source at most: their order is that
    # of whole rows.
    cut = taken.where(F.col("more") > 0).withColumnRenamed("key", "cut")
    if cut.isEmpty():
        return kept
    numbered = range_totals(
        rows.join(broadcast_if_small(cut), rows["key"].eqNullSafe(cut["cut"])).withColumns({
            "_name": F.md5(F.to_json("row")), "_id": F.monotonically_increasing_id()}),
        [F.col("cut"), F.col("_name"), F.col("_id")], {"_nr": F.lit(1)})
    starts = broadcast_if_small(numbered.groupBy(F.col("cut").alias("_cut")).agg(F.min("_nr").alias("_low")))
    first = numbered.join(starts, F.col("cut").eqNullSafe(F.col("_cut"))).withColumn(
        "copies", F.col("each") + (F.col("_nr") - F.col("_low") < F.col("more")).cast("int"))
    return kept.unionByName(first.where(F.col("copies") > 0).select(*columns))
