"""Phrase collocation mining by top-order marginalisation.

Only windows of the longest order are counted: each word of a piece leads a row of ``order`` columns, the
word and those that follow it, padded with nulls behind the piece's end. ``ROLLUP`` over the columns then
sums successively shorter prefixes, so one count of the windows holds the counts of all phrases, of all
words and of the whole language; no order has an explosion of its own.

A rollup over all windows would make nearly as many rows for each order as the text has words. Windows are
therefore cut first, without loss: a phrase that occurs ``least`` times holds only pairs that do. Pairs are
counted by a 64-bit hash (equal hashes only add counts, so no frequent pair is missed), and a window
ends before the first pair under ``least``. What is left of a window without such a pair is its first word,
whose windows add up before the shuffle. The table of frequent pairs is broadcast if its counted size
allows; beyond that the joins shuffle.

Each key is spread by all its columns and summed before the shuffle, so neither a language nor a pair that
is everywhere crowds a task. The first ``top`` phrases of a language are taken within ``SHARES`` shares of
its phrases, then among those.

Defined results: a null text is empty; a null language is ``und``, together with the language of that name;
repeated rows count again; ties in a language's order can't occur (its phrases differ); an empty table,
and one without a frequent phrase, gives no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.session import broadcast_if_small, written_table

ORDER = 5
LEAST = 100
TOP = 2_000
COVER = 100
SHARES = 64
# Frequent pairs (one long each) up to which their table may be broadcast.
BROADCAST_PAIRS = 1_000_000
ENDS = ".,;:!?\n\x0b\x0c\r"
# One pass over the characters: lower case, one character for all ends of pieces and one between words.
FROM = string.ascii_uppercase + ENDS + "\t"
TO = string.ascii_lowercase + "\n" * len(ENDS) + " "


def pieces(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """``lang`` and ``words`` of every piece that has a word."""
    plain = F.translate(F.coalesce(F.col(text), F.lit("")), FROM, TO)
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"),
                       F.explode(F.split(plain, "\n")).alias("piece"))
    words = F.array_remove(F.split("piece", " "), "")
    return rows.select("lang", words.alias("words")).where(F.size("words") > 0)


def lead_windows(split: DataFrame, order: int) -> DataFrame:
    """A row per word: ``lang``, ``w1`` (the word) to ``w<order>``, null behind the end of the piece."""
    leads = [F.col("words"), *[F.slice("words", k, F.size("words")) for k in range(2, order + 1)]]
    return split.select("lang", F.inline(F.arrays_zip(*leads)).alias(*[f"w{k}" for k in range(1, order + 1)]))


def _pair(k: int):
    """Hash of the pair that ends in column ``k``; null where the window has ended."""
    a, b = F.col(f"w{k - 1}"), F.col(f"w{k}")
    return F.when(a.isNotNull() & b.isNotNull(), F.xxhash64("lang", a, b))


def frequent_pairs(split: DataFrame, least: int) -> DataFrame:
    """Hashes that pairs have ``least`` times or more."""
    return (lead_windows(split, 2).select(_pair(2).alias("pair")).where("pair IS NOT NULL")
            .groupBy("pair").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("pair"))


def phrase_counts(docs: DataFrame, lang: str = "lang", text: str = "text", order: int = ORDER,
                  least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to ``order`` words that occur ``least`` times (``lang``, ``size``, ``phrase``, ``f``), and
    all words of each language (``lang``, ``n``)."""
    split = pieces(docs, lang, text)
    frequent = broadcast_if_small(written_table(frequent_pairs(split, least), "pairs"), BROADCAST_PAIRS)
    windows = lead_windows(split, order)
    for k in range(2, order + 1):
        known = frequent.withColumnRenamed("pair", "known")
        windows = windows.join(known, _pair(k) == F.col("known"), "left").withColumn(
            f"w{k}", F.when(F.col("known").isNotNull(), F.col(f"w{k}"))).drop("known")
    columns = ["lang", *[f"w{k}" for k in range(1, order + 1)]]
    longest = written_table(windows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")), "windows")
    # Bit k of the grouping id is set where a column is summed away.
    sums = longest.rollup(*columns).agg(F.sum("n").alias("f"), F.grouping_id().alias("gone"))
    size = F.lit(order) - F.bit_count("gone")
    last = F.coalesce(*[F.when(size == k, F.col(f"w{k}").isNotNull()) for k in range(1, order + 1)])
    sums = written_table(
        sums.select("lang", size.cast("int").alias("size"), F.concat_ws(" ", *columns[1:]).alias("phrase"), "f",
                    last.alias("whole"))
        .where((F.col("size") == 0) | (F.col("whole") & (F.col("f") >= least))).drop("whole"), "phrases")
    return (sums.where("size > 0"),
            sums.where("size = 0").select("lang", F.col("f").alias("n")))


def _part(first, count):
    return F.concat_ws(" ", F.slice("words", first, count))


def weakest_cuts(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """Per phrase of several words the cut with the lowest score: ``lang``, ``phrase``, ``size``, ``a``, ``l``, ``r``,
    ``n``, ``score``."""
    cuts = (phrases.where("size > 1").withColumnRenamed("f", "a")
            .withColumn("words", F.split("phrase", " "))
            .withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
            .select("lang", "phrase", "size", "a", "k", _part(F.lit(1), F.col("k")).alias("first"),
                    _part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest")))
    known = phrases.select("lang", F.col("phrase").alias("part"), "f")
    for side, count in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(known.withColumnRenamed("part", side), ["lang", side]).withColumnRenamed("f", count)
    cuts = cuts.join(broadcast_if_small(totals), "lang")
    long = lambda c: c.cast("decimal(19,0)")
    # Products of two longs fit 38 digits; DIV gives the whole quotient as a long.
    cuts = cuts.withColumns({"above": long(F.col("a") * 1000) * long(F.col("n")),
                             "below": long(F.col("l")) * long(F.col("r"))})
    cuts = cuts.withColumn("score", F.expr("above DIV below"))
    return (cuts.groupBy("lang", "phrase", "size", "a", "n")
            .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
            .select("lang", "phrase", "size", "a", "cut.l", "cut.r", "n", "cut.score"))


def covered_phrases(phrases: DataFrame) -> DataFrame:
    """``lang``, ``phrase``, ``most``: for phrases inside longer ones, the largest count of those."""
    words = phrases.where("size > 2").withColumn("words", F.split("phrase", " "))
    inner = (words.withColumn("length", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
             .withColumn("at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("length") + 1)))
             .select("lang", _part(F.col("at"), F.col("length")).alias("phrase"), "f"))
    return inner.groupBy("lang", "phrase").agg(F.max("f").alias("most"))


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", order: int = ORDER,
                 least: int = LEAST, top: int = TOP, cover: int = COVER) -> DataFrame:
    """The first ``top`` phrases of each language by the score of their weakest cut.

    ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``. Phrases go that lie inside a longer one
    with ``cover`` percent of their occurrences or more.
    """
    phrases, totals = phrase_counts(docs, lang, text, order, least)
    scored = (weakest_cuts(phrases, totals).join(covered_phrases(phrases), ["lang", "phrase"], "left")
              .where(F.coalesce(F.col("most") * 100 < F.col("a") * cover, F.lit(True))))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
    some = scored.withColumn("share", share).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*best)))
    ranked = some.where(F.col("rank") <= top).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)))
    return ranked.where(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
