"""A map of vectors in the plane: t-SNE of a bounded set of landmarks, and every other vector among its nearest ones.

The landmarks are the rows of least hash, at most `landmarks` of them, whatever the table's size. Their map is exact: similarities at the
perplexity asked for, found by bisection for each of them, and gradient descent with momentum and early exaggeration, from their first two principal
components. Each task then places its own rows: at the mean of the `near` nearest landmarks, weighed by the same kernel at a perplexity of a third of these. So rows
are read once and nothing of them is shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexarbor.operators import sampling


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0, (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1))


def kernel(d: np.ndarray, perplexity: float, rounds: int = 60) -> np.ndarray:
    """Rows of weights that sum to 1, exp(-beta d), with the entropy of the perplexity: beta by bisection for every row at once."""
    low, high, beta = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d)) / np.maximum(d.mean(1), 1e-12)
    d, want = d - d.min(1, keepdims=True), np.log(min(perplexity, d.shape[1]))
    for _ in range(rounds):
        p = np.exp(-beta[:, None] * d)
        total = p.sum(1)
        entropy = np.log(total) + beta * (d * p).sum(1) / total
        wide = entropy > want
        low, high = np.where(wide, beta, low), np.where(wide, high, beta)
        beta = np.where(np.isinf(high), 2 * beta, (low + high) / 2)
    return p / total[:, None]


def tsne(x: np.ndarray, perplexity: float = 30.0, rounds: int = 500) -> np.ndarray:
    """The map of a few rows, as many squared numbers in memory."""
    n = len(x)
    if n < 3:
        return np.arange(2.0 * n).reshape(n, 2)
    d = squared_distances(x, x)
    np.fill_diagonal(d, np.inf)
    own = kernel(d[~np.eye(n, dtype=bool)].reshape(n, n - 1), min(perplexity, (n - 1) / 3))
    p = np.zeros((n, n))
    p[~np.eye(n, dtype=bool)] = own.reshape(-1)
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    _, _, axes = np.linalg.svd(x - x.mean(0), full_matrices=False)
    axes = axes[:2] * np.sign(axes[:2][np.arange(len(axes[:2])), np.abs(axes[:2]).argmax(1)])[:, None]  # one sign on every machine
    y = np.zeros((n, 2))
    y[:, : len(axes)] = (x - x.mean(0)) @ axes.T
    y *= 1e-4 / max(y[:, 0].std(), 1e-12)
    rate, move, gain = max(n / 48, 50.0), np.zeros_like(y), np.ones_like(y)
    for i in range(rounds):
        q = 1 / (1 + squared_distances(y, y))
        np.fill_diagonal(q, 0)
        pull = (p * (12 if i < 250 else 1) - q / q.sum()) * q
        slope = 4 * (pull.sum(1)[:, None] * y - pull @ y)
        gain = np.maximum(np.where(np.sign(slope) != np.sign(move), gain + 0.2, gain * 0.8), 0.01)
        move = (0.5 if i < 250 else 0.8) * move - rate * gain * slope
        y = y + move
        y -= y.mean(0)
    return y


def place(x: np.ndarray, marks: np.ndarray, at: np.ndarray, near: int) -> np.ndarray:
    """Where vectors lie on the landmarks' map; a vector that equals a landmark lies there."""
    d = squared_distances(x, marks)
    first = np.argpartition(d, min(near, len(marks)) - 1, axis=1)[:, :near]
    close = np.take_along_axis(d, first, 1)
    w = kernel(close, max(1.0, close.shape[1] / 3))
    out = np.einsum("ij,ijk->ik", w, at[first])
    same = close.min(1) <= 1e-12
    out[same] = at[first[same, close[same].argmin(1)]]
    return out


def mapped(rows: DataFrame, key: str, vector: str = "embedding", landmarks: int = 2000, perplexity: float = 30.0, near: int = 15, seed: int | str = 42, rounds: int = 500) -> DataFrame:
    """rows with x and y on the map (columns of these names are replaced). Rows without a vector are left out."""
    kept = rows.drop("x", "y").filter(F.col(vector).isNotNull())
    some = sampling.sample(kept.select(key, vector), landmarks, key, seed).toPandas()
    if not len(some):
        return kept.select("*", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    marks = np.stack(some[vector].to_numpy()).astype(np.float64)
    at = tsne(marks, perplexity, rounds)
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((marks, at))

    @F.pandas_udf("x double, y double")
    def put(v: pd.Series) -> pd.DataFrame:
        marks, at = shared.value
        x = np.stack(v.to_numpy()).astype(np.float64)
        xy = np.concatenate([place(x[i : i + 1000], marks, at, near) for i in range(0, len(x), 1000)])
        return pd.DataFrame({"x": xy[:, 0], "y": xy[:, 1]})

    return kept.withColumn("_at", put(F.col(vector))).select(*kept.columns, "_at.x", "_at.y")
