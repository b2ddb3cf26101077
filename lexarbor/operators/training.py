"""Training runs by seed and condition: learning curves of a nearest-centroid classifier, all runs in one pass over the rows.

Every seed holds out its own share of the rows and deals the others to epochs; a condition learns from its share of these. After epoch e the
centroids are the means of what epochs 1 to e have brought. Sums of vectors by run, epoch and label are combined in the tasks that read the rows, so what is
shuffled and what the driver gets is a vector for each of these, whatever the number of rows. Held-out rows meet the centroids of their
seeds as a matrix in their own task. Draws are hashes of seed and key: runs replay anywhere.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexarbor.operators import sampling

HELD_OUT = 0.2


def dealt(vectors: DataFrame, key: str, seeds: list[int], epochs: int) -> DataFrame:
    """vectors with a row for each seed: seed, step (null: held out, else 0 to epochs - 1) and share (a number in [0, 1): conditions of a larger share learn from it)."""
    draws = F.array(*(F.struct(F.lit(s).alias("seed"), sampling.uniform(s, F.col(key)).alias("u"), sampling.uniform(f"{s}:share", F.col(key)).alias("share")) for s in seeds))
    rows = vectors.withColumn("_d", F.explode(draws)).select(*vectors.columns, "_d.*")
    step = F.least(F.lit(epochs - 1), F.floor((F.col("u") - HELD_OUT) / (1 - HELD_OUT) * epochs)).cast("int")
    return rows.withColumn("step", F.when(F.col("u") >= HELD_OUT, step)).drop("u")


def sums(rows: DataFrame, label: str, vector: str, conditions: dict[str, float]) -> DataFrame:
    """(seed, condition, step, label, n, total): of the rows that are learned from, combined by task."""
    kind = dict(rows.dtypes)[label]

    def add(batches):
        held: dict = {}
        for pdf in batches:
            x = np.stack(pdf["x"].to_numpy()).astype(np.float64) if len(pdf) else np.zeros((0, 0))
            for condition, share in conditions.items():
                some = pdf[pdf["share"] < share]
                for at, of in some.groupby(["seed", "step", "label"]).indices.items():
                    part = x[pdf["share"].to_numpy() < share][of]
                    n, total = held.get((condition, *at), (0, 0.0))
                    held[condition, *at] = (n + len(part), total + part.sum(0))
        if held:
            yield pd.DataFrame([(s, c, st, la, n, t) for (c, s, st, la), (n, t) in held.items()], columns=["seed", "condition", "step", "label", "n", "total"])

    learned = rows.filter(F.col("step").isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull())
    parts = learned.select("seed", "step", "share", F.col(label).alias("label"), F.col(vector).alias("x")).mapInPandas(add, f"seed long, condition string, step int, label {kind}, n long, total array<double>")
    by = ["seed", "condition", "step", "label"]
    long = parts.select(*by, "n", F.posexplode("total").alias("i", "x")).groupBy(*by, "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    return long.groupBy(*by).agg(F.min("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("total"))


def centroids(told: DataFrame, epochs: int) -> dict:
    """{seed: [(condition, epoch, labels, centroids)]} on the driver, a vector for each run, epoch and label."""
    by_run: dict = {}
    for r in told.collect():
        by_run.setdefault((r.seed, r.condition), []).append(r)
    out: dict = {}
    for (seed, condition), rows in sorted(by_run.items()):
        labels = sorted({r.label for r in rows})
        n, total = np.zeros((epochs, len(labels))), np.zeros((epochs, len(labels), len(rows[0].total)))
        for r in rows:
            n[r.step, labels.index(r.label)], total[r.step, labels.index(r.label)] = r.n, r.total
        n, total = n.cumsum(0), total.cumsum(0)
        for e in range(epochs):
            some = np.flatnonzero(n[e])
            if len(some):
                out.setdefault(seed, []).append((condition, e + 1, [labels[i] for i in some], total[e, some] / n[e, some, None]))
    return out


def predicted(rows: DataFrame, key: str, label: str, vector: str, models: dict) -> DataFrame:
    """(key, seed, condition, epoch, actual, predicted) of held-out rows: the label of the nearest centroid, the first of equals."""
    types = dict(rows.dtypes)

    def tell(batches):
        for pdf in batches:
            for seed, part in pdf.groupby("seed"):
                x = np.stack(part["x"].to_numpy()).astype(np.float64)
                for condition, epoch, labels, c in models.get(seed, []):
                    near = ((c * c).sum(1) - 2 * (x @ c.T)).argmin(1)
                    yield pd.DataFrame({"key": part["key"].to_numpy(), "seed": seed, "condition": condition, "epoch": epoch, "actual": part["label"].to_numpy(), "predicted": np.array(labels)[near]})

    held = rows.filter(F.col("step").isNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("key"), "seed", F.col(label).alias("label"), F.col(vector).alias("x"))
    return held.mapInPandas(tell, f"key {types[key]}, seed long, condition string, epoch int, actual {types[label]}, predicted {types[label]}").withColumnRenamed("key", key)


def runs(vectors: DataFrame, key: str, label: str, conditions: dict[str, float], seeds: list[int], epochs: int = 10, vector: str = "embedding") -> DataFrame:
    """predicted() of every condition (name to share of the rows), seed and epoch."""
    rows = dealt(vectors.select(key, label, vector), key, seeds, epochs)
    return predicted(rows, key, label, vector, centroids(sums(rows, label, vector, conditions), epochs))


def scores(told: DataFrame) -> DataFrame:
    """(condition, seed, epoch, label, f1) of every label that is there or was predicted, to nine places."""
    by = ["condition", "seed", "epoch"]
    matrix = told.groupBy(*by, "actual", "predicted").agg(F.count("*").alias("n"))
    side = lambda c, name: matrix.select(*by, F.col(c).alias("label"), F.col("n").alias(name))
    each = side("actual", "support").unionByName(side("predicted", "claimed"), True).unionByName(side("actual", "hit").filter("false"), True)
    each = each.unionByName(matrix.filter("actual = predicted").select(*by, F.col("actual").alias("label"), F.col("n").alias("hit")), True)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return each.groupBy(*by, "label").agg(F.round(2 * total("hit") / (total("support") + total("claimed")), 9).alias("f1"))


def curves(each: DataFrame) -> DataFrame:
    """(condition, seed, curve): macro F1 by epoch, to six places."""
    macro = each.groupBy("condition", "seed", "epoch").agg(F.round(F.avg("f1"), 6).alias("f1"))
    return macro.groupBy("condition", "seed").agg(F.transform(F.array_sort(F.collect_list(F.struct("epoch", "f1"))), lambda x: x["f1"]).alias("curve"))


def metrics(each: DataFrame, label: Column, name: str) -> DataFrame:
    """(condition, seed, metric, value) at the first epoch of best macro F1: f1_macro, and the F1 of one label under that name."""
    macro = each.groupBy("condition", "seed", "epoch").agg(F.round(F.avg("f1"), 6).alias("f1_macro"), F.coalesce(F.max(F.when(label, F.col("f1"))), F.lit(0.0)).alias(name))
    best = macro.groupBy("condition", "seed").agg(F.max_by(F.struct("f1_macro", name), F.struct("f1_macro", -F.col("epoch"))).alias("b"))
    return best.select("condition", "seed", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"b.{m}").alias("value")) for m in ("f1_macro", name)))).alias("m")).select("condition", "seed", "m.*")
