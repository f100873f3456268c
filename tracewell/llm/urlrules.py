"""URL filters: a sort-merge range join of URLs with nested host and path rules.

A rule's canonical key is its host with the labels reversed, a mark, and its path; what it covers is
the interval of keys that begin with that key. Since a rule also covers subdomains, a URL stands once
for every suffix of its host; each of these keys meets the rules of that very host and the prefixes
of its path. Keys and rules are cut into ranges at sampled borders, each range is sorted, and one
sweep keeps the stack of rules whose interval is open: the top is the longest that covers the key.
A rule goes to all ranges that its interval touches, so each sweep starts with a whole stack. An
exact comparison of host and path follows. Equal keys are told apart by a hash of the row, so one
common URL is spread over as many ranges as it needs.

The longest rule (host and path together) wins; of equally long ones the longer host, then block
before allow, then the smaller text. A URL that no rule covers gets the default verdict.

Defined results: a null URL, or one without ``://``, has an empty host and path, which no rule
covers; the host ends at ``/``, ``?``, ``#`` and is lower-cased in A-Z only; a port or user name
belongs to the host; repeated rows are judged one by one; rules with a null host or path are not read
and repeated rules count once; empty tables give no rows or the default verdict.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.session import broadcast_if_small, written_table

MARK = "\x01"
TOP = "\U0010ffff"
# Rows that one range is to hold as long as there are at most MOST_RANGES, beyond which ranges grow (a
# sweep streams, so its memory doesn't); rows looked at per border to place the borders.
RANGE_ROWS = 20_000
MOST_RANGES = 2_000
SAMPLES_PER_RANGE = 30


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.instr(url, "://") > 0, low).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0,
                  F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def host_key(host: Column) -> Column:
    """The host's labels from the last to the first."""
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def canonical_key(host: Column, path: Column) -> Column:
    return F.concat(host_key(host), F.lit(MARK), path)


def suffix_keys(host: Column, path: Column) -> Column:
    """The canonical keys of a URL, one for every suffix of its host."""
    labels = F.reverse(F.split(host, r"\.", -1))
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(
        F.array_join(F.slice(labels, F.lit(1), n), "."), F.lit(MARK), path))


def _ranges(keys: DataFrame, rows: int) -> list[str]:
    """Borders (key, mark, hash) of the ranges: a bounded number, from a sample of bounded size."""
    n = min(MOST_RANGES, -(-rows // RANGE_ROWS))
    if n <= 1:
        return []
    want = n * SAMPLES_PER_RANGE
    sample = (keys.where(F.rand(7) < min(1.0, 1.5 * want / rows)).select("sort").limit(2 * want)
              .orderBy("sort").toLocalIterator())
    got = [r["sort"] for r in sample]
    return sorted({got[i * len(got) // n] for i in range(1, n)}) if got else []


def _sweep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range, key, and rules before URLs; the top of the stack answers for each URL."""
    stack: list[tuple[str, int]] = []
    part = None
    for batch in batches:
        cols = batch.to_pydict()
        row_ids, rules = [], []
        for p, key, rule, row in zip(cols["part"], cols["key"], cols["rule"], cols["row"]):
            if p != part:
                stack, part = [], p
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if rule is not None:
                stack.append((key, rule))
            elif stack:
                row_ids.append(row)
                rules.append(stack[-1][1])
        yield pa.RecordBatch.from_pydict({"row": pa.array(row_ids, pa.int64()),
                                          "rule": pa.array(rules, pa.int64())})


def prepared_rules(rules: DataFrame) -> DataFrame:
    """``host``, ``path``, ``block``; one row per key, with a number."""
    r = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
    one = r.groupBy("host", "path").agg(F.max(F.col("block").cast("boolean")).alias("block"))
    return one.withColumn("rule", F.xxhash64("host", F.lit(MARK), "path")).withColumn(
        "key", canonical_key(F.col("host"), F.col("path")))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow"
               ) -> DataFrame:
    """All columns of ``pages`` as struct ``row``, with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has ``host``, ``path`` and ``block`` (boolean). A host matches without case only if
    the rule is in lower case, as URLs' hosts are.
    """
    rules = written_table(prepared_rules(rules), "rules")
    rows = written_table(
        pages.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("id"),
                     host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")), "urls")
    # Only hosts that some rule names can meet a rule.
    named = rules.select(host_key(F.col("host")).alias("named")).distinct()
    keys = rows.where(F.col("host") != "").select(
        F.col("id").alias("row"), F.explode(suffix_keys(F.col("host"), F.col("path"))).alias("key"))
    keys = (keys.withColumn("named", F.substring_index("key", MARK, 1))
            .join(broadcast_if_small(named), "named", "left_semi")
            .withColumn("sort", F.concat("key", F.lit(MARK + "u"),
                                         F.lpad(F.hex(F.xxhash64("row")), 16, "0"))))
    keys = written_table(keys.select("row", "key", "sort"), "url-keys")
    borders = _ranges(keys, keys.count())

    @F.arrow_udf("int")
    def range_of(sort: pa.Array) -> pa.Array:
        return pa.array([bisect_right(borders, x) for x in sort.to_pylist()], pa.int32())

    @F.arrow_udf("array<int>")
    def ranges_of(key: pa.Array) -> pa.Array:
        return pa.array([list(range(bisect_right(borders, x), bisect_left(borders, x + TOP) + 1))
                         for x in key.to_pylist()], pa.list_(pa.int32()))

    placed = keys.select(range_of("sort").alias("part"), "key", F.lit(None).cast("bigint").alias("rule"),
                         "row").unionByName(
        rules.select(F.explode(ranges_of("key")).alias("part"), "key", "rule",
                     F.lit(None).cast("bigint").alias("row")))
    met = (placed.repartition(len(borders) + 1, "part")
           .sortWithinPartitions("part", "key", F.col("rule").isNull())
           .mapInArrow(_sweep, "row bigint, rule bigint"))
    shown = rules.select("rule", "block", F.col("host").alias("r_host"), F.col("path").alias("r_path"))
    best = (
        met.join(broadcast_if_small(shown), "rule").groupBy("row").agg(F.min_by(
            F.struct("r_host", "r_path", "block"),
            F.struct((-F.length("r_host") - F.length("r_path")).alias("a"),
                     (-F.length("r_host")).alias("b"), (~F.col("block")).alias("c"),
                     F.concat("r_host", "r_path").alias("d"))).alias("best"))
        .withColumnRenamed("row", "id"))
    out = rows.join(best, "id", "left")
    fits = ((F.col("host") == F.col("best.r_host"))
            | F.endswith(F.col("host"), F.concat(F.lit("."), "best.r_host"))) & F.startswith(
        F.col("path"), F.col("best.r_path"))
    return out.select(
        "row", "host", "path",
        F.when(fits, F.concat("best.r_host", "best.r_path")).alias("rule"),
        F.when(fits, F.when(F.col("best.block"), "block").otherwise("allow")).otherwise(default)
        .alias("verdict"))
