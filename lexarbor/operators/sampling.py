"""Samples, splits and draws that depend on a seed and a key only, so that they replay in any engine and at any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def draw(seed: int | str, key: Column) -> Column:
    """The hash that orders rows: MD5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def uniform(seed: int | str, key: Column) -> Column:
    """A number in [0, 1) from 32 bits of the hash."""
    return F.conv(F.substring(draw(seed, key), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def sample(rows: DataFrame, k: int, key: str, seed: int | str) -> DataFrame:
    """k rows without replacement, or all if there are fewer: those of least hash (a top-k in each task)."""
    return rows.withColumn("_h", draw(seed, F.col(key))).orderBy("_h", key).limit(k).drop("_h")


#: Hexadecimal digits of the hash that each level of least() looks at; below the last there are a few rows, whatever the table's size.
LEVELS = (4, 8)


def least(rows: DataFrame, by: list[str], want: DataFrame, key: str, seed: int | str) -> DataFrame:
    """rows with _least: true for the _k rows of least hash of each group in want (by, _k), false for others.

    Nothing is sorted by group: counts by hash prefix give the prefix that the last wanted row has, level by level, and only rows
    with the whole of that prefix are ranked (by hash, then key; of repeated keys any). A group that want lacks gets none,
    one that has fewer rows than it wants gets all. Null groups are groups.
    """
    hashed = rows.withColumn("_h", draw(seed, F.coalesce(F.col(key).cast("string"), F.lit(""))))
    edge = want.select(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(by)), F.col("_k").alias("_left"), F.lit("").alias("_edge"))

    def at(table: DataFrame, how: str) -> DataFrame:
        same = F.lit(True)
        for i, c in enumerate(by):
            same &= F.col(c).eqNullSafe(F.col(f"_g{i}"))
        return table.join(edge, same, how)

    for digits in LEVELS:
        inside = at(hashed.select(*by, "_h"), "inner").filter(F.startswith(F.col("_h"), F.col("_edge")))
        cells = inside.groupBy(*by, "_left", F.substring("_h", 1, digits).alias("_cell")).agg(F.count("*").alias("_n"))
        before = F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        whole = F.sum("_n").over(W.partitionBy(*by))
        told = cells.withColumn("_before", before).withColumn("_left", F.least("_left", whole)).filter((F.col("_before") < F.col("_left")) & (F.col("_left") <= F.col("_before") + F.col("_n")))
        edge = told.select(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(by)), (F.col("_left") - F.col("_before")).alias("_left"), F.col("_cell").alias("_edge"))
    prefix = F.substring("_h", 1, LEVELS[-1])
    marked = at(hashed, "left")
    on_edge = F.coalesce(prefix == F.col("_edge"), F.lit(False))
    ranked = marked.filter(on_edge).withColumn("_least", F.row_number().over(W.partitionBy(*by, "_edge").orderBy("_h", key)) <= F.col("_left"))
    others = marked.filter(~on_edge).withColumn("_least", F.coalesce(prefix < F.col("_edge"), F.lit(False)))
    return ranked.unionByName(others).select(*rows.columns, "_least")


def sample_per_group(rows: DataFrame, group: str, k: int, key: str, seed: int | str) -> DataFrame:
    """k rows of each group, or all if there are fewer: those of least hash."""
    want = rows.groupBy(group).agg(F.lit(k).cast("long").alias("_k"))
    return least(rows, [group], want, key, seed).filter("_least").drop("_least")


def balanced(pool: DataFrame, groups: DataFrame, group: str, key: str, seed: int) -> DataFrame:
    """For each group (few: generators) as many rows of the pool as it has, drawn for each anew; raises if the pool is too small."""
    sizes = groups.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("_k"))
    names = sorted((r[0], r[1]) for r in sizes.collect())  # a row a generator
    n = pool.count()
    if (most := max((k for _, k in names), default=0)) > n:
        raise ValueError(f"the pool has {n} rows, a group wants {most}")
    # each pool row is dealt to every group where it stands; only counts and the drawn rows travel
    dealt = pool.withColumn(group, F.explode(F.array(*(F.lit(g) for g, _ in names)).cast(T.ArrayType(groups.schema[group].dataType))))
    own = dealt.withColumn("_own", F.concat(F.col(group).cast("string"), F.lit(":"), F.col(key).cast("string")))
    return least(own, [group], sizes, "_own", seed).filter("_least").drop("_least", "_own")


def split(rows: DataFrame, share: float, key: str, seed: int, stratum: str | None = None) -> DataFrame:
    """rows with part: `test` for round(share * n) of each stratum (or of all), `train` for the others."""
    by = [stratum] if stratum else []
    want = rows.groupBy(*by).agg(F.floor(F.lit(share) * F.count("*") + 0.5).alias("_k"))
    return least(rows, by, want, key, seed).withColumn("part", F.when(F.col("_least"), "test").otherwise("train")).drop("_least")


def weighted_choice(weights: dict[str, float], seed: int | str, key: Column) -> Column:
    """One of the names, by cumulated weights and a hashed uniform; rounding leaves the last name the rest."""
    u, total, out = uniform(seed, key) * sum(weights.values()), 0.0, None
    for name, w in weights.items():
        total += w
        out = F.when(u < total, name) if out is None else out.when(u < total, name)
    return out.otherwise(list(weights)[-1])


def temperature(seed: int | str, key: Column, low: float = 0.3, high: float = 1.2) -> Column:
    return F.round(low + (high - low) * uniform(seed, key), 2)


def choice(pool: list, seed: int | str, key: Column) -> Column:
    """A uniform choice from a pool."""
    return F.element_at(F.array(*(F.lit(p) for p in pool)), (F.floor(uniform(seed, key) * len(pool)) + 1).cast("int"))


def choose(pool: list, k: int, seed: int | str, key: Column) -> Column:
    """k different members of a pool: those of least hash."""
    hashed = F.transform(F.array(*(F.lit(p) for p in pool)), lambda p: F.struct(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"), F.lit(":"), p)).alias("h"), p.alias("p")))
    return F.transform(F.slice(F.array_sort(hashed), 1, k), lambda x: x["p"])


def whole_number(low: int, high: int, seed: int | str, key: Column) -> Column:
    return (low + F.floor(uniform(seed, key) * (high - low + 1))).cast("int")
