"""Linear classifiers of many groups at once: every round reads the rows a single time, whatever the number of groups.

Each group has its own two-class problem: its rows against rows of others. The loss is that of a linear support vector machine
with squared hinge, |w|^2 / 2 + C sum(max(0, 1 - y w x)^2), the constant term being a weight like any other. It is piecewise quadratic, so Newton's
method ends after a few rounds. A round adds up gradients and second derivatives of all groups in the tasks that hold the rows;
partial sums are added in two steps, and the driver gets one matrix a group. So vectors may have some hundred dimensions (MOST), and groups are few.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexarbor.operators import dedup, evaluation, sampling

#: The most dimensions of a vector.
MOST = 1024
#: Parts in which the partial sums of a group are added before they are added up.
PARTS = 64


def added(rows: DataFrame, kernel: Callable, by: str, arrays: list[str], kind: str = "string") -> DataFrame:
    """(by, arrays) from kernel, which gives (by, arrays) of a task's rows: summed element by element, no group's partial sums in one place."""
    schema = f"{by} {kind}, " + ", ".join(f"{a} array<double>" for a in arrays)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({by: pdf[by].iloc[:1], **{a: [np.sum(np.stack(pdf[a].to_numpy()), axis=0)] for a in arrays}})

    parts = rows.mapInPandas(kernel, schema).withColumn("_part", F.spark_partition_id() % PARTS)
    return parts.groupBy(by, "_part").applyInPandas(add, schema).groupBy(by).applyInPandas(add, schema)


def matrix(column: pd.Series) -> np.ndarray:
    """A column of vectors as a matrix with a last column of ones."""
    x = np.stack(column.to_numpy()).astype(np.float64)
    return np.c_[x, np.ones(len(x))]


def squared_hinge(rows: DataFrame, groups: list[str], size: int, c: float = 1.0, rounds: int = 30, tolerance: float = 1e-8) -> np.ndarray:
    """(groups x (size + 1)) weights from rows (x, sign): sign is an array with 1, -1 or 0 (not asked) for each group."""
    weights, last, before = np.zeros((len(groups), size + 1)), np.full(len(groups), np.inf), np.zeros((len(groups), size + 1))
    for _ in range(rounds):

        def slopes(batches, w=weights):
            out: dict = {}
            for pdf in batches:
                if not len(pdf):
                    continue
                x, sign = matrix(pdf["x"]), np.stack(pdf["sign"].to_numpy())
                gap = 1 - sign * (x @ w.T)
                for g in range(len(groups)):
                    on = np.flatnonzero((sign[:, g] != 0) & (gap[:, g] > 0))
                    xs, y, d = x[on], sign[on, g], gap[on, g]
                    loss, slope, bend = out.get(g, (0.0, 0.0, 0.0))
                    out[g] = (loss + (d * d).sum(), slope - 2 * (y * d) @ xs, bend + 2 * xs.T @ xs)
            if out:
                yield pd.DataFrame([(groups[g], [loss], slope, bend.reshape(-1)) for g, (loss, slope, bend) in out.items()], columns=["g", "loss", "slope", "bend"])

        told = {r.g: r for r in added(rows, slopes, "g", ["loss", "slope", "bend"]).collect()}  # a row a group
        moved = 0.0
        for i, g in enumerate(groups):
            if g not in told:
                continue
            loss = 0.5 * weights[i] @ weights[i] + c * told[g].loss[0]
            if loss > last[i] + 1e-12 * abs(last[i]):
                weights[i] = (weights[i] + before[i]) / 2  # too far: half the step
                moved = np.inf
                continue
            step = np.linalg.solve(np.eye(size + 1) + c * np.array(told[g].bend).reshape(size + 1, size + 1), weights[i] + c * np.array(told[g].slope))
            before[i], last[i] = weights[i].copy(), loss
            weights[i] -= step
            moved = max(moved, np.abs(step).max())
        if moved < tolerance:
            break
    return weights


def pad_leaderboard(rows: DataFrame, group: str, key: str, vector: str = "embedding", seed: int = 42, c: float = 1.0) -> DataFrame:
    """(group, n, error, pad), lowest distance first: how well a linear SVM tells each group (few: generators) from other rows.

    A fifth of every group is held out, once for all distances. Of the rows of other groups each is drawn with the probability that gives as many as the
    group has, by a hash of seed, group and key. A group without other rows, or without held-out ones, has no distance. Rows without a group or a vector don't count.
    """
    dedup.ensure_checkpoints(rows.sparkSession)
    whole = rows.filter(F.col(group).isNotNull() & F.col(vector).isNotNull()).select(F.col(group).cast("string").alias("_g"), F.col(group).alias("_group"), F.col(key).alias("key"), F.transform(vector, lambda v: v.cast("double")).alias("x"))
    sizes = {r._g: r.n for r in whole.groupBy("_g").agg(F.count("*").alias("n")).collect()}  # a row a group
    groups = sorted(g for g, n in sizes.items() if sum(sizes.values()) > n)
    if not groups:
        return rows.limit(0).select(group, F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("error"), F.lit(0.0).alias("pad"))
    size = whole.select(F.size("x").alias("n")).first().n
    if size > MOST:
        raise ValueError(f"vectors of {size} dimensions; {MOST} at most")
    rest = sum(sizes.values())
    drawn = [F.when(F.col("_g") == g, 1.0).when(sampling.uniform(f"{seed}:{g}", F.col("key")) < sizes[g] / (rest - sizes[g]), -1.0).otherwise(0.0) for g in groups]
    dealt = sampling.split(whole, 0.2, "key", seed, "_g").select("x", "part", F.array(*drawn).alias("sign")).checkpoint()
    weights = squared_hinge(dealt.filter("part = 'train'").select("x", "sign"), groups, size, c)

    def judged(batches):
        out: dict = {}
        for pdf in batches:
            if len(pdf):
                sign = np.stack(pdf["sign"].to_numpy())
                wrong = (matrix(pdf["x"]) @ weights.T > 0) != (sign > 0)
                for g in range(len(groups)):
                    on = sign[:, g] != 0
                    out[g] = out.get(g, np.zeros(2)) + [on.sum(), (wrong[:, g] & on).sum()]
        if out:
            yield pd.DataFrame([(groups[g], n) for g, n in out.items()], columns=["_g", "counts"])

    told = added(dealt.filter("part = 'test'").select("x", "sign"), judged, "_g", ["counts"]).filter("counts[0] > 0").withColumn("error", F.expr("counts[1] / counts[0]"))
    named = whole.groupBy("_g", F.col("_group").alias(group)).agg(F.count("*").alias("n"))
    return told.join(F.broadcast(named), "_g").select(group, "n", "error", evaluation.distance(F.col("error")).alias("pad")).orderBy("pad", group)  # a row a group
