"""Fit of Spark's multilayer perceptron over large tables.

Spark's own fit multiplies small matrices in the JVM (the README has the times). The same loss
(sigmoid layers, softmax, cross entropy, the mean over all rows) and its gradient are summed here by NumPy inside the
tasks, every row in every pass; the driver sees their sums and holds the weights. Blocks are computed in single
precision and added up in double.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import (
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows multiplied at once, rows in one part at most, and parts whose sums the driver adds up without a tree.
BLOCK_ROWS, PART_ROWS, FLAT_PARTS = 2048, 500_000, 64
# Pairs kept of earlier steps, values over which the loss must fall, and trials along one direction.
PAIRS, MEMORY, TRIALS = 10, 20, 30


@dataclass
class BlockPerceptron:
    """Takes standardised ``features`` and a class number ``label``; ``fit`` returns Spark's own model."""

    layers: list[int]
    iters: int
    seed: int = 0
    tol: float = 1e-6

    def fit(self, df: DataFrame) -> MultilayerPerceptronClassificationModel:
        start = self.carry(df.sparkSession).weights.toArray()
        blocks = row_blocks(df, self.layers[0]).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            weights, _ = minimise(lambda w: mean_loss(blocks, w, self.layers), start, self.iters, self.tol)
        finally:
            blocks.unpersist()
        return self.carry(df.sparkSession, weights)

    def carry(self, spark: SparkSession, weights=None) -> MultilayerPerceptronClassificationModel:
        """Spark's model with these weights, or with its own random ones: a fit of no iterations."""
        learner = MultilayerPerceptronClassifier(layers=self.layers, maxIter=0, seed=self.seed)
        if weights is not None:
            learner = learner.setInitialWeights(Vectors.dense(weights))
        row = (Vectors.dense([0.0] * self.layers[0]), 0.0)
        return learner.fit(spark.createDataFrame([row], ["features", "label"]))


def row_blocks(df: DataFrame, width: int) -> RDD:
    """(features x rows, classes) arrays, in even parts that fill the cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = cores * max(1, -(-df.count() // (PART_ROWS * cores)))

    def stack(batches):
        import pyarrow as pa
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            y = batch.column(1).to_numpy(zero_copy_only=False)
            cuts = [slice(i, i + BLOCK_ROWS) for i in range(0, len(y), BLOCK_ROWS)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([np.ascontiguousarray(x[c].T).tobytes() for c in cuts], pa.binary()),
                 pa.array([y[c].tobytes() for c in cuts], pa.binary())], ["x", "y"])

    rows = df.select(vector_to_array("features", "float32"), F.col("label").cast("int"))
    return rows.mapInArrow(stack, "x binary, y binary").repartition(parts).rdd.map(
        lambda r: (np.frombuffer(r["x"], np.float32).reshape(width, -1), np.frombuffer(r["y"], np.int32)))


def matrices(weights: np.ndarray, layers: list[int]) -> list[np.ndarray]:
    """Spark's flat weights as one (out x in + 1) matrix per layer, the bias last."""
    out, at = [], 0
    for n, k in zip(layers, layers[1:]):
        out.append(weights[at:at + (n + 1) * k].reshape(n + 1, k).T)
        at += (n + 1) * k
    return out


def loss_sums(blocks, weights: np.ndarray, layers: list[int]) -> np.ndarray:
    """Rows, summed loss and summed gradient of some blocks."""
    mats = [np.ascontiguousarray(m, dtype=np.float32) for m in matrices(weights, layers)]
    classes = np.arange(layers[-1], dtype=np.int32)[:, None]
    rows, loss, slopes = 0, 0.0, [np.zeros(m.shape) for m in mats]
    for x, y in blocks:
        acts = [np.ones((n + 1, y.size), np.float32) for n in layers[:-1]]
        acts[0][:-1] = x
        with np.errstate(over="ignore"):  # exp(-z) may be infinite, its unit is 0 then
            for m, a, b in zip(mats, acts, acts[1:]):
                z = np.matmul(m, a, out=b[:-1])
                np.exp(np.negative(z, out=z), out=z)
                z += 1
                np.reciprocal(z, out=z)
        z = mats[-1] @ acts[-1]
        z -= z.max(axis=0)
        hot = y == classes
        e = np.exp(z)
        total = e.sum(axis=0)
        rows += y.size
        loss += float((np.log(total) - (z * hot).sum(axis=0)).sum(dtype=np.float64))
        e /= total
        e -= hot
        for i in range(len(mats) - 1, -1, -1):
            slopes[i] += e @ acts[i].T
            if i:
                a = acts[i][:-1]
                e = mats[i][:, :-1].T @ e
                e *= a
                e *= 1 - a
    return np.concatenate([[rows, loss], *[s.T.ravel() for s in slopes]])


def mean_loss(blocks: RDD, weights: np.ndarray, layers: list[int]) -> tuple[float, np.ndarray]:
    """Mean loss over all rows and its gradient, in one pass."""
    sums = blocks.mapPartitions(lambda part: [loss_sums(part, weights, layers)])
    total = sums.treeReduce(np.add, depth=1 if blocks.getNumPartitions() <= FLAT_PARTS else 2)
    if not total[0]:
        raise ValueError("no rows to fit on")
    return float(total[1] / total[0]), total[2:] / total[0]


def minimise(cost, x: np.ndarray, iters: int, tol: float) -> tuple[np.ndarray, list[float]]:
    """L-BFGS as Spark's fit sets it up: ten pairs, the same end conditions. Weights and loss per iteration."""
    f, g = cost(x)
    losses, pairs = [f], []
    while len(losses) <= iters and np.linalg.norm(g) > max(tol * abs(f), 1e-8):
        d = direction(g, pairs)
        step = 1.0 if pairs else 1.0 / np.linalg.norm(g)
        found = search(cost, x, f, g, d, step)
        if found is None:
            break
        new, f, slope = found
        pairs = [*pairs, (new - x, slope - g)][-PAIRS:]
        x, g = new, slope
        fell = max(losses[-MEMORY:]) - f
        losses.append(f)
        if fell <= tol * abs(losses[0]):
            break
    return x, losses


def direction(g: np.ndarray, pairs: list) -> np.ndarray:
    """Downhill direction from the gradient and the last steps (two loops)."""
    d, kept = -g, []
    for s, y in reversed(pairs):
        a = (s @ d) / (s @ y)
        d = d - a * y
        kept.append(a)
    if pairs:
        s, y = pairs[-1]
        d = d * ((s @ y) / (y @ y))
    for (s, y), a in zip(pairs, reversed(kept)):
        d = d + (a - (y @ d) / (s @ y)) * s
    return d


def search(cost, x, f, g, d, step):
    """A point along ``d`` where the loss falls and flattens enough (Wolfe); secants of the slope between two bounds."""
    low, high, slope = 0.0, np.inf, g @ d
    low_slope, high_slope = slope, None
    for _ in range(TRIALS):
        new = x + step * d
        value, at = cost(new)
        if not value <= f + 1e-4 * step * slope:
            high, high_slope = step, at @ d
        elif at @ d < 0.9 * slope:
            low, low_slope = step, at @ d
        else:
            return new, value, at
        if high_slope is None:
            step *= 2
        else:
            part = low_slope / (low_slope - high_slope) if high_slope > 0 else 0.5
            step = low + (high - low) * min(max(part, 0.1), 0.9)
    return None
