"""Centroid clustering with progressive search over Walsh-Hadamard coefficients.

Vectors become integers, and those and the centroids are transformed by the integer Walsh-Hadamard
transform, which is exact: the squared distance of two vectors is a 64th of that of their coefficients. The
coefficients are ordered coarse to fine, by the number of sign changes of their row. A search adds up the
squared differences band by band. A centroid is out as soon as its sum so far is strictly larger than the
whole distance of another one, so none that is nearest, or ties with it, is ever lost; what is left at the end
has all coefficients, and the smallest number wins a tie.

The transformed vectors are written once and read in each round. A task adds up its vectors' coefficients
per cluster and passes on one row per cluster; Spark adds those. Only the centroids (``clusters`` rows of 64
numbers) go through the driver. The new centroid is the transform back of the sum, whole-number divided.

Defined results: vectors that are null, have another length, or hold a null, NaN or infinity are left out;
components beyond 65,536 count as that, so that distances fit a long; a repeated row is a vector of its own
and may start as two centroids, of which the second stays empty; vectors with equal ids are ordered by
their components, and null ids come last; with fewer vectors than ``clusters`` each starts one; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.session import written_table

DIMENSION = 64
CLUSTERS = 40
ROUNDS = 5
SCALE = 256
# Bound of a scaled component: 64 * 64 * (2 * bound) ** 2 stays below 2 ** 63.
LARGEST = 1 << 24
BANDS = (0, 8, 16, 32, 64)
ROWS = 2_048


def _sign_changes() -> np.ndarray:
    rows = np.ones((1, 1), np.int64)
    while len(rows) < DIMENSION:
        rows = np.block([[rows, rows], [rows, -rows]])
    return np.count_nonzero(np.diff(rows, axis=1), axis=1)


COARSE_TO_FINE = np.argsort(_sign_changes())


def transform(rows: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients of integer rows, coarse to fine."""
    out, half = np.array(rows, np.int64), 1
    while half < DIMENSION:
        pairs = out.reshape(-1, DIMENSION // (2 * half), 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2)
        half *= 2
    return out.reshape(-1, DIMENSION)[:, COARSE_TO_FINE]


def back(coefficients: list[int], count: int) -> list[int]:
    """Whole quotients of the vector with these coefficients by ``count``, in whole numbers of any size."""
    out = [0] * DIMENSION
    for at, c in zip(COARSE_TO_FINE.tolist(), coefficients):
        out[at] = c
    half = 1
    while half < DIMENSION:
        for start in range(0, DIMENSION, 2 * half):
            for i in range(start, start + half):
                out[i], out[i + half] = out[i] + out[i + half], out[i] - out[i + half]
        half *= 2
    return [x // DIMENSION // count for x in out]


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each row's nearest centroid; both sides are coefficients."""
    part = np.zeros((len(rows), len(centroids)), np.int64)
    for c in range(BANDS[1]):
        part += (rows[:, c, None] - centroids[None, :, c]) ** 2
    # The whole distance of the best so far bounds that of the nearest.
    most = ((rows - centroids[part.argmin(axis=1)]) ** 2).sum(axis=1)
    row, number = np.nonzero(part <= most[:, None])
    so_far = part[row, number]
    for low, high in zip(BANDS[1:], BANDS[2:]):
        so_far = so_far + ((rows[row, low:high] - centroids[number, low:high]) ** 2).sum(axis=1)
        stay = so_far <= most[row]
        row, number, so_far = row[stay], number[stay], so_far[stay]
    order = np.lexsort((number, so_far, row))
    first = order[np.unique(row[order], return_index=True)[1]]
    return number[first], so_far[first] // DIMENSION


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), DIMENSION)


def _usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & (F.size(vector) == DIMENSION) & fine


def _scaled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.clip(np.floor(_matrix(batch.column("vector")) * float(SCALE)), -LARGEST, LARGEST).astype(np.int64)
        ends = pa.array(np.arange(0, (len(rows) + 1) * DIMENSION, DIMENSION, dtype=np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in (rows, transform(rows))]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), *lists], ["vec_id", "whole", "coefficients"])


def coefficients(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id``, ``whole`` (the vector in integers) and ``coefficients`` of every usable vector."""
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    return rows.where(_usable(F.col("vector"))).mapInArrow(
        _scaled, "vec_id bigint, whole array<bigint>, coefficients array<bigint>")


def _blocks(batches: Iterable[pa.RecordBatch], centroids: np.ndarray):
    """Vectors in blocks: ids, coefficients, numbers and distances."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            some = batch.slice(at, ROWS)
            rows = _matrix(some.column("coefficients"))
            yield some, rows, *nearest(rows, centroids)


def _sums(centroids: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = [0] * len(centroids), [[0] * DIMENSION for _ in centroids]
        for _, rows, number, _ in _blocks(batches, centroids):
            for k in np.unique(number).tolist():
                mine = rows[number == k]
                counts[k] += len(mine)
                sums[k] = [a + b for a, b in zip(sums[k], mine.sum(axis=0).tolist())]
        held = [k for k, n in enumerate(counts) if n]
        yield pa.RecordBatch.from_pydict(
            {"cluster": pa.array(held, pa.int32()), "n": pa.array([counts[k] for k in held], pa.int64()),
             "sums": pa.array([sums[k] for k in held], pa.list_(pa.int64()))})

    return run


def _assigned(centroids: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, _, number, distance in _blocks(batches, centroids):
            yield pa.RecordBatch.from_arrays(
                [some.column("vec_id"), pa.array(number, pa.int32()), pa.array(distance, pa.int64())],
                ["vec_id", "cluster", "distance"])

    return run


def first_centroids(ready: DataFrame, clusters: int) -> list[list[int]]:
    """The vectors with the smallest hashes; ``clusters`` rows at most."""
    key = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = ready.select(key.alias("key"), "whole").orderBy(F.asc_nulls_last("key"), "whole").limit(clusters)
    return [list(r["whole"]) for r in rows.collect()]


def move(ready: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """One round: all vectors go to their nearest centroid, which goes to their mean, rounded down."""
    partial = ready.select("coefficients").mapInArrow(
        _sums(transform(np.array(centroids))), "cluster int, n bigint, sums array<bigint>")
    exact = [F.sum(F.col("sums")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(DIMENSION)]
    out = list(centroids)
    for r in partial.groupBy("cluster").agg(F.sum("n").alias("n"), *exact).collect():
        out[r["cluster"]] = back([int(r[f"s{i}"]) for i in range(DIMENSION)], r["n"])
    return out


def cluster_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS,
                    rounds: int = ROUNDS) -> DataFrame:
    """``vec_id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` and ``centroid_sha256`` of each vector."""
    spark = vectors.sparkSession
    ready = written_table(coefficients(vectors, vec_id, vector), "coefficients")
    centroids = first_centroids(ready, clusters)
    for _ in range(rounds if centroids else 0):
        centroids = move(ready, centroids)
    found = ready.select("vec_id", "coefficients").mapInArrow(
        _assigned(transform(np.array(centroids, np.int64).reshape(-1, DIMENSION))),
        "vec_id bigint, cluster int, distance bigint")
    found = written_table(found, "assigned")
    # A row per cluster, ``clusters`` at most.
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}
    facts = [(k, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest())
             for k, s in sums.items()]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
