"""Training runs of a small network in a barrier stage: tasks keep their rows and exchange gradients.

A run is a condition (a share of the rows) and a seed (what is held out, the order of the rows, the first weights). All runs are trained side by side
in one stage of a few tasks. In every step each task works out the gradient of its own rows and gets the sum of all tasks' from the barrier, so all hold the
same weights; the steps of an epoch go through the training rows once. Losses are weighted by balanced classes, the rate rises over the first tenth of the
steps and falls to 0 after that, and a run ends when its macro F1 on the held-out rows hasn't risen for `patience` epochs.

A lost task fails the stage, which begins anew: the same weights come out, as nothing depends on the tasks but the order of sums. Gradients pass the driver's
barrier coordinator, which takes about a second each time, and rows stay in the tasks' memory: this is for training sets of some gigabytes, not for a corpus.
"""

from __future__ import annotations

import base64
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexarbor.operators import sampling

CURVE = "condition string, seed long, epoch int, train_loss double, val_loss double, val_macro_f1 double, learning_rate double, best boolean"


class Net:
    """One hidden layer with tanh, softmax; weights as one flat array."""

    def __init__(self, size: int, hidden: int, classes: int, seed: int):
        self.shape = [(size, hidden), (hidden,), (hidden, classes), (classes,)]
        rng = np.random.default_rng(seed)
        parts = [rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) > 1 else np.zeros(s) for s in self.shape]
        self.w = np.concatenate([p.reshape(-1) for p in parts])
        self.m, self.v, self.step = np.zeros_like(self.w), np.zeros_like(self.w), 0

    def parts(self, w: np.ndarray) -> list[np.ndarray]:
        at = np.r_[0, np.cumsum([int(np.prod(s)) for s in self.shape])]
        return [w[a:b].reshape(s) for a, b, s in zip(at[:-1], at[1:], self.shape, strict=True)]

    def probabilities(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b, c, d = self.parts(self.w)
        h = np.tanh(x @ a + b)
        z = h @ c + d
        e = np.exp(z - z.max(1, keepdims=True)) if len(z) else z
        return h, e / e.sum(1, keepdims=True) if len(z) else z

    def slope(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The gradient of the summed weighted loss, and after it that loss and the sum of weights."""
        h, p = self.probabilities(x)
        loss = -(weight * np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))).sum()
        up = p * weight[:, None]
        up[np.arange(len(y)), y] -= weight
        back = (up @ self.parts(self.w)[2].T) * (1 - h * h)
        return np.concatenate([(x.T @ back).reshape(-1), back.sum(0), (h.T @ up).reshape(-1), up.sum(0), [loss, weight.sum()]])

    def move(self, slope: np.ndarray, rate: float) -> None:
        self.step += 1
        self.m, self.v = 0.9 * self.m + 0.1 * slope, 0.999 * self.v + 0.001 * slope * slope
        self.w = self.w - rate * (self.m / (1 - 0.9**self.step)) / (np.sqrt(self.v / (1 - 0.999**self.step)) + 1e-8)


def macro_f1(matrix: np.ndarray) -> float:
    """Over the labels that are there or were predicted."""
    hit, both = np.diag(matrix), matrix.sum(0) + matrix.sum(1)
    return float((2 * hit[both > 0] / both[both > 0]).mean()) if both.any() else 0.0


def train(data: dict, runs: list[tuple[str, float, int]], size: int, classes: int, total: Callable[[np.ndarray], np.ndarray], hidden: int, epochs: int, steps: int, peak: float, patience: int, held_out: float) -> list[tuple]:
    """Rows of CURVE of all runs. data: this task's rows as x, y, and for each seed draw and share; total: the sum of an array over all tasks."""
    x, y = data["x"], data["y"]
    nets = [Net(size, hidden, classes, seed) for *_, seed in runs]
    learn = [(data["draw"][seed] >= held_out) & (data["share"][seed] < share) for _, share, seed in runs]
    held = [data["draw"][seed] < held_out for *_, seed in runs]
    # which step of an epoch a row belongs to, by another digit of its draw
    turn = [(data["share"][seed] / share * steps).astype(np.int64) for _, share, seed in runs]
    n = total(np.concatenate([np.bincount(y[k], minlength=classes) for k in learn]).astype(np.float64)).reshape(len(runs), classes)
    weight = n.sum(1, keepdims=True) / np.maximum((n > 0).sum(1, keepdims=True) * n, 1)
    state = [{"best": -1.0, "epoch": 0, "idle": 0, "on": n[r].sum() > 0} for r in range(len(runs))]
    out, whole = [], epochs * steps
    for epoch in range(1, epochs + 1):
        on = [r for r in range(len(runs)) if state[r]["on"]]
        if not on:
            break
        lost = {r: np.zeros(2) for r in on}
        for s in range(steps):
            at = (epoch - 1) * steps + s + 1
            up = max(1, whole // 10)
            rate = peak * (at / up if at < up else max(0.0, (whole - at) / max(1, whole - up)))
            rows = [np.flatnonzero(learn[r] & (turn[r] == s)) for r in on]
            slopes = total(np.concatenate([nets[r].slope(x[i], y[i], weight[r][y[i]]) for r, i in zip(on, rows, strict=True)])).reshape(len(on), -1)
            for r, g in zip(on, slopes, strict=True):
                lost[r] += g[-2:]
                if g[-1] > 0:
                    nets[r].move(g[:-2] / g[-1], rate)
        seen = []
        for r in on:
            _, p = nets[r].probabilities(x[held[r]])
            true = y[held[r]]
            matrix = np.zeros((classes, classes))
            np.add.at(matrix, (true, p.argmax(1) if len(true) else true), 1)
            seen.append(np.r_[matrix.reshape(-1), -np.log(np.maximum(p[np.arange(len(true)), true], 1e-300)).sum()])
        for r, told in zip(on, total(np.concatenate(seen)).reshape(len(on), -1), strict=True):
            f1, one = macro_f1(told[:-1].reshape(classes, classes)), state[r]
            if f1 > one["best"]:
                one |= {"best": f1, "epoch": epoch, "idle": 0}
            else:
                one["idle"] += 1
            one["on"] = one["idle"] < patience
            out.append((runs[r][0], runs[r][2], epoch, lost[r][0] / max(lost[r][1], 1e-300), told[-1] / max(told[:-1].sum(), 1.0), f1, rate))
    return [(*row, row[2] == next(state[r]["epoch"] for r in range(len(runs)) if (runs[r][0], runs[r][2]) == row[:2])) for row in out]


def prepared(pdf: pd.DataFrame, seeds: list[int], size: int) -> dict:
    pdf = pdf.sort_values("key", kind="stable")
    x = np.stack(pdf["x"].to_numpy()).astype(np.float64) if len(pdf) else np.zeros((0, size))
    draws = {c: np.stack(pdf[c].to_numpy()) if len(pdf) else np.zeros((0, len(seeds))) for c in ("draw", "share")}
    return {"x": x, "y": pdf["code"].to_numpy(np.int64), **{c: {s: a[:, i] for i, s in enumerate(seeds)} for c, a in draws.items()}}


def learning_curves(rows: DataFrame, key: str, label: str, conditions: dict[str, float], seeds: list[int], vector: str = "embedding", hidden: int = 32, epochs: int = 10, steps: int = 2, peak: float = 0.05, patience: int = 2, held_out: float = 0.2, tasks: int = 4) -> DataFrame:
    """One row per run and epoch: condition, seed, epoch, train_loss, val_loss, val_macro_f1, learning_rate, best (the epoch of the best macro F1).

    Labels are few. Rows without a label or a vector don't count; tasks: how many hold the rows, no more than may run at once.
    """
    spark = rows.sparkSession
    whole = rows.filter(F.col(label).isNotNull() & F.col(vector).isNotNull())
    labels = sorted(r[0] for r in whole.select(label).distinct().collect())
    if not labels:
        return spark.createDataFrame([], CURVE)
    size = whole.select(F.size(vector).alias("n")).first().n
    code = F.array_position(F.array(*(F.lit(x) for x in labels)), F.col(label)) - 1
    draws = lambda name: F.array(*(sampling.uniform(f"{s}{name}", F.col(key)) for s in seeds))
    dealt = whole.select(F.col(key).alias("key"), code.alias("code"), F.transform(vector, lambda v: v.cast("double")).alias("x"), draws("").alias("draw"), draws(":share").alias("share"))
    runs = [(c, share, s) for c, share in conditions.items() for s in seeds]

    def kernel(batches):
        from pyspark import BarrierTaskContext

        context = BarrierTaskContext.get()

        def total(a: np.ndarray) -> np.ndarray:
            return np.sum([np.frombuffer(base64.b64decode(p)) for p in context.allGather(base64.b64encode(a.tobytes()).decode())], axis=0)

        held = list(batches)
        data = prepared(pd.concat(held, ignore_index=True) if held else pd.DataFrame({c: [] for c in ("key", "code", "x", "draw", "share")}), seeds, size)
        told = train(data, runs, size, len(labels), total, hidden, epochs, steps, peak, patience, held_out)
        if context.partitionId() == 0:
            yield pd.DataFrame(told, columns=[c.split()[0] for c in CURVE.split(", ")])

    return dealt.repartition(min(tasks, spark.sparkContext.defaultParallelism), "key").mapInPandas(kernel, CURVE, barrier=True)
