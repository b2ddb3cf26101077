"""Embedding measures: mean pairwise cosine, cosine to centroids, TransRate."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexarbor.operators import dedup, linear


def coordinates(vectors: DataFrame, key: list[str], vector: str = "embedding") -> DataFrame:
    """(key, i, x) in long form."""
    return vectors.select(*key, F.posexplode(F.transform(vector, lambda v: v.cast("double"))).alias("i", "x"))


def _norm(vector: str):
    return F.sqrt(F.aggregate(F.transform(vector, lambda v: v.cast("double") * v.cast("double")), F.lit(0.0), lambda a, v: a + v))


def unit(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Vectors scaled to length one, as doubles; zero vectors stay."""
    return vectors.withColumn("_n", _norm(vector)).withColumn(vector, F.transform(vector, lambda v: F.when(F.col("_n") > 0, v.cast("double") / F.col("_n")).otherwise(v.cast("double")))).drop("_n")


def pairwise_cosine(vectors: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """(group, n, mean_cosine): over all pairs, by (|sum u|^2 - sum |u|^2) / (n (n - 1)); null below two vectors."""
    scaled = unit(vectors.filter(F.col(vector).isNotNull()), vector)
    sums = coordinates(scaled, [group], vector).groupBy(group, "i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    n = scaled.groupBy(group).agg(F.count("*").alias("n"))
    total = sums.groupBy(group).agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum("q").alias("q"))
    return n.join(total, group).select(group, "n", F.when(F.col("n") >= 2, (F.col("ss") - F.col("q")) / (F.col("n") * (F.col("n") - 1))).alias("mean_cosine"))


def centroids(vectors: DataFrame, label: str, vector: str = "embedding") -> DataFrame:
    return coordinates(vectors, [label], vector).groupBy(label, "i").agg(F.avg("x").alias("c"))


def centroid_cosine(vectors: DataFrame, centers: DataFrame, key: str, label: str, vector: str = "embedding") -> DataFrame:
    """(label, mean_cosine): of vectors to their label's centroid; labels without one are left out."""
    joined = coordinates(vectors, [key, label], vector).join(centers, [label, "i"])
    each = joined.groupBy(key, label).agg(F.sum(F.col("x") * F.col("c")).alias("dot"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("a"), F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("b"))
    return each.groupBy(label).agg(F.avg(F.when((F.col("a") > 0) & (F.col("b") > 0), F.col("dot") / (F.col("a") * F.col("b"))).otherwise(0.0)).alias("mean_cosine"))


def macro(per_label: DataFrame, value: str = "mean_cosine") -> DataFrame:
    """The mean over labels; 0 where there is none."""
    return per_label.agg(F.coalesce(F.avg(value), F.lit(0.0)).alias(f"macro_{value}"))


def moments(vectors: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """(group, n, total, product): the vectors' sum and the sum of their outer products (row-major), one row per group (as text; null is a group).

    Each task adds its own rows up first, and what tasks have of a group is added in two steps, so a hot group costs a row per task.
    """

    def add(batches):
        held: dict = {}
        for pdf in batches:
            for g, part in pdf.groupby("g", dropna=False):
                x = np.stack(part["x"].to_numpy()).astype(np.float64)
                n, s, p = held.get(g, (0.0, 0.0, 0.0))
                held[g] = (n + len(x), s + x.sum(0), p + x.T @ x)
        if held:
            yield pd.DataFrame([(g, [n], s, p.reshape(-1)) for g, (n, s, p) in held.items()], columns=["g", "n", "total", "product"])

    rows = vectors.filter(F.col(vector).isNotNull()).select(F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("g"), F.col(vector).alias("x"))
    told = linear.added(rows, add, "g", ["n", "total", "product"])
    return told.select(F.when(F.col("g") != "", F.substr("g", F.lit(2))).alias(group), F.col("n")[0].cast("long").alias("n"), "total", "product")


def transrate(vectors: DataFrame, label: str, vector: str = "embedding", epsilon: float = 1e-4) -> DataFrame:
    """One row (n, transrate): half the log-determinant of the covariance (+ epsilon I) less the same inside labels, weighed by their shares; 0 below two vectors.

    A label of one vector gives nothing. Determinants are taken by the tasks that hold a label's moments; no matrix leaves the executors.
    """

    def half_logdet(n, s, p):
        d = len(s)
        cov = (p.reshape(d, d) - np.outer(s, s) / n) / (n - 1)
        return 0.5 * np.linalg.slogdet(cov + epsilon * np.eye(d))[1]

    def each(batches):
        for pdf in batches:
            yield pd.DataFrame({"n": pdf["n"], "v": [half_logdet(n, s, p) if n > 1 else 0.0 for n, s, p in zip(pdf["n"], pdf["total"], pdf["product"], strict=True)]})

    dedup.ensure_checkpoints(vectors.sparkSession)
    parts = moments(vectors, label, vector).checkpoint()
    inside = parts.mapInPandas(each, "n long, v double").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("v")).alias("inside"))
    whole = linear.added(
        parts.select("n", "total", "product"), lambda batches: (pd.DataFrame([("", [float(pdf["n"].sum())], np.sum(np.stack(pdf["total"]), axis=0), np.sum(np.stack(pdf["product"]), axis=0))], columns=["g", "n", "total", "product"]) for pdf in batches if len(pdf)), "g", ["n", "total", "product"]
    ).select(F.col("n")[0].cast("long").alias("n"), "total", "product").mapInPandas(each, "n long, v double")
    rate = F.when(F.col("m") >= 2, F.col("v") - F.col("inside") / F.col("m")).otherwise(0.0)
    return inside.join(whole, F.col("m") == F.col("n"), "left").select(F.coalesce("m", F.lit(0)).alias("n"), F.coalesce(rate, F.lit(0.0)).alias("transrate"))  # one row each
