"""Near copies by exact Jaccard similarity over word shingles.

A text's set holds the XXH64 of its distinct shingles. Candidates come from prefixes, without loss: if
all shingles stand in one fixed order, two sets of n and m shingles with a similarity of ``similarity`` or
more share one of the first n - ceil(similarity n) + 1 of the one and the same of the other, and neither
has fewer than ``similarity`` times the shingles of the other. Their first common shingle, at places i and j,
leaves room for 1 + min(n - i, m - j) common ones at most. Any order is right. To make few candidates,
shingles that are common in a sample of the documents come last; the sample has no effect on results.

Before any set moves, candidates are compared by parity bitmaps: each shingle flips one of two to four
times n bits. Two sets differ in at least as many shingles as their bitmaps in bits, and at a similarity of
``similarity`` in (1 - similarity) / (1 + similarity) times n + m at most, so no pair is lost. A bitmap is a
32nd of its set, and hardly a pair below the limit survives it.

What survives is decided by the whole sets, in two rounds. First each text is compared with the pairs that
another search brings in (``search``, for the pipeline the fingerprints' pivot tables) and with its neighbour by
size and the smallest one under every shared shingle, which joins the bulk of large groups. Then all pairs
of near sizes are compared that aren't in one component yet.

Defined results: texts with equal sets are near copies, also those without words (or null); texts with
fewer words than a shingle have one shingle; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from tracewell.llm.components import components
from tracewell.llm.words import lower_words
from tracewell.session import broadcast_if_small, written_table

SIZE = 5
SIMILARITY = 0.8
SEED = 42
SAMPLE = 20_000
COMMON = 100_000
EPS = 1e-9


def shingle_set(text: bytes | None, size: int = SIZE) -> np.ndarray:
    """XXH64 of the distinct shingles, in order."""
    tokens = lower_words(text)
    if not tokens:
        return np.zeros(0, np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    runs = zip(*[tokens[i:] for i in range(size)]) if len(tokens) >= size else [tokens]
    return np.unique(np.array([digest(join(r), SEED) for r in runs], np.uint64))


def prefix(shingles: np.ndarray, common: np.ndarray, rank: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set, those in ``common`` last by ``rank``."""
    n = len(shingles)
    if not n:
        return shingles
    length = n - int(np.ceil(similarity * n - EPS)) + 1
    at = np.minimum(np.searchsorted(common, shingles), max(len(common) - 1, 0))
    late = common[at] == shingles if len(common) else np.zeros(n, bool)
    rare = shingles[~late][:length]
    if len(rare) == length:
        return rare
    return np.concatenate([rare, shingles[late][np.argsort(rank[at[late]])][:length - len(rare)]])


def parity(shingles: np.ndarray) -> np.ndarray:
    """Bitmap of a set as 64-bit numbers, 2 to 4 bits a shingle: which bits an odd number of them flips."""
    bits = 64
    while bits < 2 * len(shingles):
        bits *= 2
    flips = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(bool), bitorder="little").view(np.uint64)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.uint64), *rows]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def shingle_sets(text: Column, size: int) -> Column:
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def of(col: pa.Array) -> pa.Array:
        return _lists([shingle_set(t.as_py(), size) for t in col])

    return of(text.cast("binary"))


def common_shingles(docs: DataFrame, text: str, size: int) -> list[int]:
    """Shingles that a sample of the documents holds three times or more, the rarest first."""
    every = max(1, docs.count() // SAMPLE)
    sample = docs.where(F.pmod(F.xxhash64(text), F.lit(every)) == 0)
    counts = sample.select(F.explode(shingle_sets(F.col(text), size)).alias("h")).groupBy("h").agg(
        F.count(F.lit(1)).alias("n")).where(F.col("n") > 2)
    return [r["h"] for r in counts.orderBy(F.desc("n"), "h").limit(COMMON).collect()][::-1]


def signatures(text: Column, common: list[int], size: int, similarity: float) -> Column:
    """``node`` (the hash of the set), ``n`` (its shingles), ``prefix`` and ``parity`` of a text."""
    @F.arrow_udf(T.StructType([T.StructField("node", T.LongType()), T.StructField("n", T.LongType()),
                               T.StructField("prefix", T.ArrayType(T.LongType())),
                               T.StructField("parity", T.ArrayType(T.LongType()))]))
    def of(cols: Iterator[pa.Array]) -> Iterator[pa.Array]:
        late = np.array(common, np.int64).view(np.uint64)
        rank = np.argsort(late)
        late = late[rank]
        for col in cols:
            sets = [shingle_set(t.as_py(), size) for t in col]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64)
            yield pa.StructArray.from_arrays(
                [pa.array(nodes.view(np.int64)), pa.array([len(s) for s in sets], pa.int64()),
                 _lists([prefix(s, late, rank, similarity) for s in sets]), _lists([parity(s) for s in sets])],
                ["node", "n", "prefix", "parity"])

    return of(text.cast("binary"))


def _distance(x: str, y: str) -> Column:
    """Bits in which two bitmaps differ; the halves of the longer one are laid over each other first."""
    def fitted(a, b):
        half = F.size(b)
        return F.when(F.size(a) > half, F.zip_with(
            F.slice(a, F.lit(1), half), F.slice(a, half + 1, half), lambda p, q: p.bitwiseXOR(q))).otherwise(F.col(a))

    bits = F.zip_with(fitted(x, y), fitted(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.aggregate(bits, F.lit(0), lambda total, b: total + b)


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE,
                similarity: float = SIMILARITY, fp: Column | None = None,
                search: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``doc_id``, ``text_hash``, ``root`` (equal for all texts of a component) of every document.

    ``search`` takes the ``node`` and fingerprint ``fp`` of every document and gives pairs ``a``, ``b`` of nodes, which
    are decided by their sets like all others.
    """
    common = common_shingles(docs, text, size)
    prints = written_table(
        docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"),
                    *([] if fp is None else [fp.alias("fp")]),
                    signatures(F.col(text), common, size, similarity).alias("s"))
        .select("doc_id", "text_hash", *([] if fp is None else ["fp"]), "s.*"), "prints")
    several = F.count(F.lit(1)).over(Window.partitionBy("h"))
    places = prints.select("node", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("place", "h"))
    shared = written_table(
        places.repartition("h").distinct().withColumn("several", several).where(F.col("several") > 1)
        .select("h", "node", "n", "place"), "shared")
    fits = lambda low, high: low >= similarity * high - EPS

    # A row whose neighbours by size are out of reach has no candidate at all.
    by_size = Window.partitionBy("h").orderBy("n", "node")
    beside = F.array(F.lag(F.struct("node", "n")).over(by_size), F.first(F.struct("node", "n")).over(by_size))
    first = (shared.select("node", "n", beside.alias("beside")).select("node", "n", F.explode("beside").alias("x"))
             .where((F.col("x.node") != F.col("node")) & fits(F.col("x.n"), F.col("n")))
             .select(F.least("node", "x.node").alias("a"), F.greatest("node", "x.node").alias("b")))
    if search is not None:
        first = first.unionByName(search(prints.select("node", "fp")).where(F.col("a") != F.col("b")).select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    first = written_table(first.distinct(), "pairs")
    wanted = written_table(first.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "wanted")
    bitmaps = written_table(
        prints.select("node", "n", "parity", "text_hash").join(broadcast_if_small(wanted), "node").groupBy("node").agg(
            F.first("n").alias("n"), F.first("parity").alias("parity"), F.min("text_hash").alias("text_hash")), "bitmaps")

    def both(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
        for side, mark in (("a", "x"), ("b", "y")):
            pairs = pairs.join(table.select(F.col("node").alias(side), *[
                F.col(c).alias(f"{mark}_{c}") for c in columns]), side)
        return pairs

    near = _distance("x_parity", "y_parity") <= (
        (1 - similarity) / (1 + similarity) * (F.col("x_n") + F.col("y_n")) + EPS)

    def similar(pairs: DataFrame) -> DataFrame:
        """The pairs that reach the similarity; only sets of pairs that the bitmaps leave are made."""
        left = written_table(both(pairs, bitmaps, ["n", "parity"]).where(near).select(pairs.columns), "near")
        nodes = left.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        texts = broadcast_if_small(written_table(bitmaps.join(nodes, "node").select("node", "text_hash"), "texts"))
        sets = (docs.select(F.xxhash64(text).alias("text_hash"), F.col(text).alias("text")).join(texts, "text_hash")
                .groupBy("node").agg(F.first("text").alias("text"))
                .select("node", shingle_sets(F.col("text"), size).alias("set")))
        whole = both(left, written_table(sets, "sets"), ["set"])
        same = F.size(F.array_intersect("x_set", "y_set"))
        return whole.where(fits(same, F.size("x_set") + F.size("y_set") - same)).select(pairs.columns)

    linked = written_table(components(similar(first)).withColumnRenamed("root", "r"), "linked")
    rooted = shared.join(wanted, "node", "left_semi").join(linked, "node", "left").select(
        "h", "node", "n", "place", F.coalesce("r", "node").alias("root"))
    under = Window.partitionBy("h")
    rooted = written_table(rooted.withColumn("apart", F.min("root").over(under) != F.max("root").over(under))
                           .where("apart").drop("apart"), "rooted")
    # Sizes that fit are in the same class or the next one; y is the larger set. The bitmaps are asked inside
    # the join, so that a passage that many unlike texts share gives no rows.
    step = F.floor(F.log(F.col("n").cast("double")) / float(np.log(1 / similarity)) + EPS)
    rooted = rooted.join(bitmaps.select("node", "parity"), "node").withColumn("step", step)
    x, y = ({c: f"{mark}_{c}" for c in rooted.columns} for mark in "xy")
    x, y = rooted.withColumnsRenamed(x), rooted.withColumn("step", F.explode(F.array("step", F.col("step") - 1))).withColumnsRenamed(y)
    # Places count from 0.
    room = F.least(F.col("x_n") - F.col("x_place"), F.col("y_n") - F.col("y_place"))
    rest = x.join(y, (F.col("x_h") == F.col("y_h")) & (F.col("x_step") == F.col("y_step"))
                  & ((F.col("x_n") < F.col("y_n")) | (F.col("x_n") == F.col("y_n")) & (F.col("x_node") < F.col("y_node")))
                  & (F.col("x_root") != F.col("y_root")) & fits(F.col("x_n"), F.col("y_n"))
                  & (room >= similarity / (1 + similarity) * (F.col("x_n") + F.col("y_n")) - EPS) & near)
    rest = rest.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b"),
                       F.col("x_root").alias("u"), F.col("y_root").alias("v"))
    rest = rest.distinct().join(first, ["a", "b"], "left_anti")
    more = components(similar(rest).select(F.col("u").alias("a"), F.col("v").alias("b"))).select(
        F.col("node").alias("r"), F.col("root").alias("top"))
    found = prints.select("doc_id", "text_hash", "node").join(linked, "node", "left").select(
        "doc_id", "text_hash", F.coalesce("r", "node").alias("r"))
    return found.join(more, "r", "left").select("doc_id", "text_hash", F.coalesce("top", "r").alias("root"))
