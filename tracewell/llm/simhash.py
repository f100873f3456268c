"""SimHash near-deduplication with pivot distance tables.

A text's fingerprint has 64 bits, each the majority of that bit over the hashes of its word
shingles. Fingerprints link if at most ``bits`` bits differ. Distances to reference fingerprints
(pivots) are precomputed: since they can't differ by more than the distance of the two fingerprints
does, a pair is discarded if any of its pivot coordinates differ by more than ``bits``. Survivors are
verified bit by bit.

To distribute the search, the bits are cut into ``bits`` + 3 blocks. Two linked fingerprints agree
in at least three of them, so every choice of three blocks is a table, keyed by their bits, and a
pair meets in one of the tables at least. Inside a bucket the fingerprints are sorted by the first
pivot coordinate and compared in a window of ``bits`` of it. A bucket with more than ``BUCKET`` distinct
fingerprints is cut again by the same rule on the bits that its key leaves free: they are cut into
``bits`` + 1 groups, one of which must agree. That goes on until buckets are small or hardly any
bits are free, which bounds them for good, so no pair is lost and no bucket is large. A bucket passes
on a spanning forest of its links, not all of them. Components come from ``components``.

Defined results: a text without words (or null) has fingerprint zero, linked like any other; texts
with fewer words than a shingle have one shingle; repeated rows have equal results; a null id takes
part but is never the smallest, and a component of null ids has a null id; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.components import components
from tracewell.llm.similar import near_copies
from tracewell.llm.words import lower_words
from tracewell.session import broadcast_if_small, materialize, written_table

SHINGLE = 3
BITS = 3
SEED = 42
BUCKET = 2_048
PIVOTS = np.random.default_rng(64).integers(0, 1 << 64, 16, dtype=np.uint64, endpoint=False)


def shingle_hashes(tokens: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle, repeats included."""
    if not tokens:
        return np.zeros(0, np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(tokens) < size:
        return np.array([digest(join(tokens), SEED)], np.uint64)
    runs = zip(*[tokens[i:] for i in range(size)])
    return np.array([digest(join(r), SEED) for r in runs], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """Bits that are 1 in over half of the hashes."""
    n = len(hashes)
    if n < 2_000:
        ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64)
    else:
        ones = np.array([np.count_nonzero(hashes & np.uint64(1 << k)) for k in range(64)])
    return sum(1 << k for k in np.flatnonzero(2 * ones > n).tolist())


def fingerprints(text: Column, sizes: tuple[int, ...] = (SHINGLE,)) -> Column:
    """The fingerprints of a whole text for some shingle sizes, as signed 64-bit numbers."""
    names = [f"f{size}" for size in sizes]

    @F.arrow_udf(T.StructType([T.StructField(n, T.LongType()) for n in names]))
    def of(col: pa.Array) -> pa.Array:
        rows = np.zeros((len(col), len(sizes)), np.uint64)
        for i, t in enumerate(col.to_pylist()):
            tokens = lower_words(t)
            rows[i] = [simhash(shingle_hashes(tokens, size)) for size in sizes]
        return pa.StructArray.from_arrays(
            [pa.array(np.ascontiguousarray(rows[:, k]).view(np.int64)) for k in range(len(sizes))], names)

    return of(text.cast("binary"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _cut(positions: list[int], parts: int) -> list[int]:
    """Bit masks of nearly equal runs of the positions."""
    return [sum(1 << int(p) for p in run) for run in np.array_split(positions, parts)]


def table_masks(bits: int) -> list[int]:
    blocks = _cut(list(range(64)), bits + 3)
    return [sum(c) for c in combinations(blocks, 3)]


def finer_masks(mask: int, bits: int) -> list[int]:
    free = [p for p in range(64) if not mask >> p & 1]
    return [mask | m for m in _cut(free, bits + 1)]


def _join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Gives linked rows their smallest common label, in place; labels are row numbers."""
    while len(i):
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        while not np.array_equal(up := label[label], label):
            label[:] = up
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]


def linked_rows(group: np.ndarray, fp: np.ndarray, bits: int, check: np.ndarray | None = None,
                check_bits: int = 64) -> np.ndarray:
    """Per row the first row of its group that it is linked to, directly or over others.

    Rows are sorted by group, then by the distance to the first pivot. ``check`` is a second
    fingerprint that must agree up to ``check_bits``.
    """
    coords = np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    label = np.arange(len(fp))
    near = np.arange(len(fp))
    step = 0
    while len(near):
        step += 1
        near = near[near + step < len(fp)]
        near = near[(group[near] == group[near + step])
                    & (coords[near + step, 0] - coords[near, 0] <= bits)]
        i = near[label[near] != label[near + step]]
        i = i[np.abs(coords[i] - coords[i + step]).max(axis=1, initial=0) <= bits]
        i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= bits]
        if check is not None:
            i = i[np.bitwise_count(check[i] ^ check[i + step]) <= check_bits]
        _join_labels(label, i, i + step)
    return label


def _links(bits: int, check_bits: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("mask", "key", "fp", "check", "node")
        held = {c: np.zeros(0, np.int64) for c in names}

        def found(rows):
            new = np.ones(len(rows["fp"]), bool)
            new[1:] = (rows["mask"][1:] != rows["mask"][:-1]) | (rows["key"][1:] != rows["key"][:-1])
            label = linked_rows(np.cumsum(new), rows["fp"].view(np.uint64), bits,
                                rows["check"].view(np.uint64), check_bits)
            at = np.flatnonzero(label != np.arange(len(label)))
            return pa.RecordBatch.from_pydict(
                {"a": pa.array(rows["node"][at]), "b": pa.array(rows["node"][label[at]])})

        for batch in batches:
            rows = {c: np.concatenate([held[c], batch.column(c).to_numpy(zero_copy_only=False)])
                    for c in names}
            # The last group may go on in the next batch.
            last = (rows["mask"] == rows["mask"][-1:]) & (rows["key"] == rows["key"][-1:])
            held = {c: rows[c][last] for c in names}
            yield found({c: rows[c][~last] for c in names})
        yield found(held)

    return run


def links(nodes: DataFrame, bits: int = BITS, bucket: int = BUCKET, check_bits: int = 64) -> DataFrame:
    """Links (``a``, ``b``) of nodes whose components are those of all links.

    ``nodes`` has ``node`` (its number), ``fp`` and ``check``, distinct.
    """
    held = ["fp", "check", "node"]

    def keyed(df, masks):
        return df.select(F.explode(masks).alias("mask"), *held).select(
            "mask", F.col("mask").bitwiseAND(F.col("fp")).alias("key"), *held)

    masks, parts = table_masks(bits), []
    level = keyed(nodes, F.array(*[F.lit(_signed(m)) for m in masks]))
    while True:
        crowded = level.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where(
            F.col("n") > bucket).drop("n")
        crowded = materialize(crowded)
        if crowded.isEmpty() or 64 - masks[0].bit_count() <= bucket.bit_length() - 1:
            parts.append(level)
            break
        parts.append(level.join(crowded, ["mask", "key"], "left_anti"))
        finer = {m: finer_masks(m, bits) for m in masks}
        masks = sorted({m for ms in finer.values() for m in ms}, key=lambda m: m.bit_count())
        split = nodes.sparkSession.createDataFrame(
            [(_signed(m), [_signed(x) for x in ms]) for m, ms in finer.items()],
            "mask bigint, finer array<bigint>")
        level = level.join(crowded, ["mask", "key"]).join(F.broadcast(split), "mask")
        level = written_table(keyed(level.select("finer", *held), F.col("finer")).distinct(), "finer")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    first = F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(int(PIVOTS[0])))))
    return (every.repartition("mask", "key").sortWithinPartitions("mask", "key", first)
            .mapInArrow(_links(bits, check_bits), "a bigint, b bigint"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = BITS,
                    size: int = SHINGLE, check_size: int | None = None, check_bits: int = 64) -> DataFrame:
    """``doc_id``, ``fp``, ``text_hash``, ``root`` (the component's first node), ``component_id``.

    With ``check_size`` a second fingerprint, over shingles of that size, must agree up to
    ``check_bits`` as well.
    """
    sizes = (size,) if check_size is None else (size, check_size)
    read = docs.select(F.col(doc_id).alias("doc_id"), fingerprints(F.col(text), sizes).alias("f"),
                       F.xxhash64(text).alias("text_hash"))
    fp = F.col(f"f.f{size}")
    check = F.lit(0).cast("bigint") if check_size is None else F.col(f"f.f{check_size}")
    node = fp if check_size is None else F.xxhash64(fp, check)
    prints = written_table(read.select("doc_id", fp.alias("fp"), check.alias("check"), "text_hash",
                                       node.alias("node")), "prints")
    nodes = written_table(prints.groupBy("node").agg(
        F.min("doc_id").alias("first_id"), F.min("fp").alias("fp"), F.min("check").alias("check")), "nodes")
    linked = components(links(nodes, bits, check_bits=check_bits)).withColumnRenamed("node", "linked")
    roots = nodes.join(linked, F.col("node") == F.col("linked"), "left").select(
        "node", "first_id", F.coalesce("root", "node").alias("root"))
    ids = roots.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = roots.select("node", "root").join(ids, "root")
    return prints.join(named, "node").select("doc_id", "fp", "text_hash", "root", "component_id")


def linked_sets(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """Pairs (``a``, ``b``) of the nodes of ``prints`` (``node``, ``fp``) whose fingerprints link.

    The pivot tables run over the distinct fingerprints. A fingerprint is stood for by its smallest node: that one is
    paired with the others of the fingerprint and with those of linked fingerprints, so many texts with one
    fingerprint make a star.
    """
    held = written_table(prints.select("fp", "node").distinct(), "held")
    firsts = written_table(held.groupBy("fp").agg(F.min("node").alias("node")), "fingerprints")
    found = links(firsts.select(F.col("fp").alias("node"), "fp", F.lit(0).cast("bigint").alias("check")), bits)
    side = lambda fp, node: firsts.select(F.col("fp").alias(fp), F.col("node").alias(node))
    near = found.select(F.col("a").alias("p"), F.col("b").alias("q")).join(side("p", "a"), "p").join(side("q", "b"), "q")
    same = held.join(firsts.withColumnRenamed("node", "a"), "fp").where(F.col("node") != F.col("a"))
    return near.select("a", "b").unionByName(same.select("a", F.col("node").alias("b")))


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5,
                     similarity: float = 0.8) -> DataFrame:
    """The documents that come first in their component, with all their columns.

    Near copies are documents with a Jaccard similarity of ``similarity`` or more over shingles of
    ``size`` words. The pivot tables link the fingerprints of all texts; at 0.8 these links miss about half of the
    pairs and hold others, so an exact check by the sets follows and a prefix filter brings in the missed ones (``similar``).
    """
    found = written_table(near_copies(docs, doc_id, text, size, similarity,
                                      fingerprints(F.col(text))[f"f{SHINGLE}"], linked_sets), "found")
    ident = ["doc_id", "text_hash"]
    firsts = found.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("x"))
    rows = written_table(
        found.groupBy("root", *ident).agg(F.count(F.lit(1)).alias("n")).join(firsts, "root").select(
            *ident, "n", (F.col("doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("text_hash") == F.col("x.text_hash")))
            .alias("first")), "rows")
    read = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"))

    def meet(some: DataFrame, how: str) -> DataFrame:
        """``read`` with or without the given rows; only they travel if they are few."""
        other = broadcast_if_small(some.select(F.col("doc_id").alias("i"), F.col("text_hash").alias("h")))
        return read.join(other, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("h")), how)

    alone = meet(rows.where(~F.col("first") | (F.col("n") > 1)), "left_anti")
    # Rows with equal id and text: the one whose row has the smallest hash stays.
    one = meet(rows.where(F.col("first") & (F.col("n") > 1)), "left_semi").groupBy(*ident).agg(
        F.min_by("row", F.xxhash64("row")).alias("row"))
    return alone.select("row.*").unionByName(one.select("row.*"))
