"""Student's t and multiple comparisons. Everything but the t distribution itself is a column expression."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def t_cdf(t: float, df: int) -> float:
    """P(T <= t) for whole degrees of freedom, by the finite series in theta = atan(t / sqrt(df))."""
    theta = math.atan2(t, math.sqrt(df))
    s, c = math.sin(theta), math.cos(theta)
    if df % 2:
        total, term = 0.0, c
        for i in range(3, df + 1, 2):
            total += term
            term *= c * c * (i - 1) / i
        area = 2 / math.pi * (theta + s * total)
    else:
        total, term = 0.0, 1.0
        for i in range(2, df + 1, 2):
            total += term
            term *= c * c * (i - 1) / i
        area = s * total
    return 0.5 + area / 2


def t_quantile(p: float, df: int) -> float:
    low, high = -1e6, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2


def two_sided_p(t: Column, df: Column) -> Column:
    """Two-sided p of t; null where t is null or has no degrees of freedom. One row per test: a pandas UDF will do."""

    @F.pandas_udf("double")
    def p(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) or pd.isna(n) or n < 1 else min(1.0, 2 * (1 - t_cdf(abs(x), int(n)))) for x, n in zip(t, df, strict=True)], dtype="float64")

    return p(t, df)


def critical_t(df: Column, confidence: float = 0.95) -> Column:
    @F.pandas_udf("double")
    def quantile(df: pd.Series) -> pd.Series:
        known = {n: t_quantile((1 + confidence) / 2, int(n)) for n in df.dropna().unique() if n >= 1}
        return df.map(known).astype("float64")

    return quantile(df)


def holm(tests: DataFrame, by: list[str], p: str = "p", alpha: float = 0.05) -> DataFrame:
    """tests with p_holm and significant: step-down correction inside each group; null p stay out of the count."""
    known = tests.filter(F.col(p).isNotNull())
    ranked = W.partitionBy(*by).orderBy(p)
    scaled = (F.count("*").over(W.partitionBy(*by)) - F.row_number().over(ranked) + 1) * F.col(p)
    out = known.withColumn("_scaled", scaled).withColumn("p_holm", F.least(F.lit(1.0), F.max("_scaled").over(ranked.rangeBetween(W.unboundedPreceding, 0)))).drop("_scaled")
    return out.withColumn("significant", F.col("p_holm") <= alpha).unionByName(tests.filter(F.col(p).isNull()), allowMissingColumns=True)
