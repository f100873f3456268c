"""Line deduplication by suffix ranks over line-ID sequences, in column functions only.

A document is a sequence of line IDs (64-bit hashes of its trimmed lines that have a word). Prefix
doubling gives every suffix the rank of its first 1, 2, 4, ... lines: the rank of 2k lines is made
of the ranks of k lines at the suffix and k lines on. A rank is a 64-bit name instead of an ordinal,
so each round is computed beside the text and nothing but the last step is shuffled. Two overlapping
ranks name a prefix of any length, and the suffixes that share the name of a prefix are one interval
of the suffix array whose longest common prefix is at least that long.

A run of lines with at least ``min_words`` words that occurs again is deleted where it occurs later
(by document id, then line). The union of all such maximal repeated runs is the union of their
shortest parts with enough words: from every line forward and from every line backward, the fewest
lines that hold ``min_words`` words. So these two prefixes per line are looked up, forward ones
among suffixes, backward ones among the mirrored suffixes. The first copy of a line never goes.

Defined results: null texts and texts without repeated runs stay as they are; blank lines between
deleted lines go with them; a null id sorts before all others; rows that share an id count as one
document, so equal lines at equal places of both stay; ids are integers; an empty table gives no rows.

Hot runs: names are counted with map-side combination and joined back on the name; no group is
collected, and adaptive execution splits a crowded name. A document's lines stay in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.words import WORD, word_count

MIN_WORDS = 50
BLANK = " \t\n\x0b\x0c\r"


def _held(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that later expressions refer to instead of repeating them.

    The optimizer merges projections, which would compute an array again for each of its elements;
    it doesn't merge across a generator.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _name(ranks: list[str], at, length) -> Column:
    """The name of ``length`` lines from ``at``: two ranks that overlap, and the length."""
    out = None
    for k in reversed(range(len(ranks))):
        pair = F.xxhash64(F.get(ranks[k], at), F.get(ranks[k], at + length - (1 << k)), length)
        out = pair if out is None else F.when(length < 2 << k, pair).otherwise(out)
    return out


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def run_names(docs: DataFrame, min_words: int) -> DataFrame:
    """``id``, ``text_hash``, and per line up to two rows: ``way``, ``name``, the places ``at`` to
    ``end`` among lines with words, and the line numbers there."""
    levels = max(1, min_words.bit_length())
    rows = _held(
        docs.select("id", "text_hash", "text").where(F.col("text").isNotNull()),
        all=F.filter(F.transform(_lines(F.col("text")), lambda x, n: F.struct(
            F.xxhash64(F.trim(x, F.lit(BLANK))).alias("h"),
            F.regexp_count(x, F.lit(WORD)).alias("w"), n.alias("n"))), lambda x: x["w"] > 0))
    rows = _held(
        rows.where(F.aggregate("all", F.lit(0).cast("bigint"), lambda a, x: a + x["w"]) >= min_words)
        .select("id", "text_hash", "all"),
        r0=F.transform("all", lambda x: x["h"]), w=F.transform("all", lambda x: x["w"]),
        n=F.transform("all", lambda x: x["n"]), count=F.size("all")).drop("all")
    empty = F.array().cast("array<bigint>")
    for k in range(1, levels):
        half, before = 1 << (k - 1), f"r{k - 1}"
        rows = _held(rows, **{f"r{k}": F.when(
            F.col("count") >= 2 * half,
            F.transform(F.sequence(F.lit(0), F.col("count") - 2 * half), lambda i: F.xxhash64(
                F.get(before, i), F.get(before, i + half)))).otherwise(empty)})
    ranks = [f"r{k}" for k in range(levels)]

    def fewest(counts):
        # How many of the leading counts reach min_words; 0 if all together don't.
        zero = F.struct(F.lit(0).alias("s"), F.lit(0).alias("n"))
        return F.aggregate(
            counts, zero, lambda a, x: F.when(a["s"] >= min_words, a).otherwise(
                F.struct((a["s"] + x).alias("s"), (a["n"] + 1).alias("n"))),
            lambda a: F.when(a["s"] >= min_words, a["n"]).otherwise(0))

    every = F.sequence(F.lit(0), F.col("count") - 1)
    rows = _held(
        rows,
        ahead=F.transform(every, lambda i: F.struct(i.alias("at"), fewest(
            F.slice("w", i + 1, F.lit(min_words))).alias("len"))),
        back=F.transform(every, lambda i: F.struct(i.alias("end"), fewest(F.reverse(F.slice(
            "w", F.greatest(i - min_words + 1, F.lit(0)) + 1,
            F.least(i + 1, F.lit(min_words))))).alias("len"))))
    spans = F.concat(
        F.transform(F.filter("ahead", lambda x: x["len"] > 0), lambda x: F.struct(
            F.lit(0).alias("way"), x["at"].alias("at"), x["len"].alias("len"))),
        F.transform(F.filter("back", lambda x: x["len"] > 0), lambda x: F.struct(
            F.lit(1).alias("way"), (x["end"] - x["len"] + 1).alias("at"), x["len"].alias("len"))))
    rows = _held(rows, spans=spans).drop("ahead", "back")
    named = F.transform("spans", lambda s: F.struct(
        s["way"].alias("way"), _name(ranks, s["at"], s["len"]).alias("name"), s["at"].alias("at"),
        (s["at"] + s["len"] - 1).alias("end"), F.get("n", s["at"]).alias("first_line"), F.get("n", s["at"] + s["len"] - 1).alias("last_line")))
    return rows.select("id", "text_hash", F.inline(named))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Line numbers to delete: ``id``, ``text_hash`` and the arrays ``first``, ``last`` of disjoint
    stretches in order."""
    runs = run_names(docs, min_words).withColumn(
        "place", F.col("id").cast("decimal(38,0)") * F.lit(1 << 40) + F.col("at"))
    firsts = (runs.groupBy("way", "name").agg(F.min("place").alias("first_place"),
                                              F.max("place").alias("last_place"))
              .where(F.col("first_place") < F.col("last_place")).drop("last_place"))
    later = runs.join(firsts, ["way", "name"]).where(F.col("place") > F.col("first_place"))
    by_line = Window.partitionBy("id", "text_hash").orderBy("at", "end")
    seen = F.max("end").over(by_line.rowsBetween(Window.unboundedPreceding, -1))
    marked = (
        later.select("id", "text_hash", "at", "end", "first_line", "last_line")
        .withColumn("opens", F.coalesce(F.col("at") > seen + 1, F.lit(True)).cast("int"))
        .withColumn("stretch", F.sum("opens").over(by_line)))
    return (
        marked.groupBy("id", "text_hash", "stretch")
        .agg(F.min("first_line").alias("a"), F.max("last_line").alias("b"))
        .groupBy("id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("s"))
        .select("id", "text_hash", F.transform("s", lambda x: x["a"]).alias("first"),
                F.transform("s", lambda x: x["b"]).alias("last")))


def without_stretches(text: Column, first: Column, last: Column) -> Column:
    """The text without the lines of the stretches: the slices between them, joined."""
    def kept(lines):
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(first)), lambda j: F.slice(
            lines, F.coalesce(F.get(last, j - 1), F.lit(-1)) + 2,
            F.coalesce(F.get(first, j), F.size(lines)) - F.coalesce(F.get(last, j - 1), F.lit(-1)) - 1)))

    # One split per text: the lines are the only element of an array that transform() binds.
    return F.get(F.transform(F.array(_lines(text)), lambda x: F.array_join(kept(x), "\n")), 0)


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                min_words: int = MIN_WORDS) -> DataFrame:
    """``row`` (all columns as a struct), ``text`` without later copies, ``lines_removed``."""
    rows = docs.select(
        F.struct("*").alias("row"), F.coalesce(F.col(doc_id).cast("bigint"), F.lit(-(1 << 63)))
        .alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    cuts = repeated_runs(rows, min_words)
    out = rows.drop("text").join(cuts, ["id", "text_hash"], "left")
    old = F.col(f"row.{text}")
    removed = F.aggregate(F.zip_with("first", "last", lambda a, b: b - a + 1),
                          F.lit(0), lambda s, x: s + x)
    return out.select(
        "row", F.when(F.col("first").isNull(), old).otherwise(
            without_stretches(old, F.col("first"), F.col("last"))).alias("text"),
        F.coalesce(removed, F.lit(0)).cast("bigint").alias("lines_removed"))


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                        min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with the same columns and without later copies; those left without a word go."""
    out = dedup_lines(docs, doc_id, text, min_words)
    left = out.where((F.col("lines_removed") == 0) | (word_count(F.col("text")) > 0))
    return left.select(*[F.col("text").alias(text) if c == text else F.col(f"row.`{c}`")
                         for c in docs.columns])
