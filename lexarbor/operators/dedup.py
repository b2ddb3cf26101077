"""Near-duplicate removal by MinHash bands with first-wins semantics: a document goes if an earlier one that stays
shares a band with it. No pairs are made: rounds of minima over the buckets decide, starting from the smallest."""

from __future__ import annotations

import atexit
import functools
import hashlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRIME = 2147483647
PERMUTATIONS, BANDS, ROWS = 128, 8, 16


def coefficients(n: int = PERMUTATIONS) -> list[tuple[int, int]]:
    """(a, b) of each permutation h -> (a h + b) mod 2^31 - 1, from powers of 48271 mod 2^31 - 1 (a fixed rule that SQL can follow, too)."""
    x, out = 1, []
    for _ in range(n):
        x = x * 48271 % PRIME
        a = x
        x = x * 48271 % PRIME
        out.append((a, x))
    return out


#: Words of documents that are hashed together; a longer document is a piece of its own, in parts.
PIECE = 1 << 17


def _minima(words: pa.Array, starts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The minima of all permutations over each run of words that begins at starts (no run is empty)."""
    coded = words.dictionary_encode()
    own = np.array([int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "big") % PRIME for w in coded.dictionary.to_pylist()], np.int64)
    at = coded.indices.to_numpy(zero_copy_only=False)
    out = np.empty((len(starts), len(table)), np.int64)
    for i, (a, b) in enumerate(table):
        out[:, i] = np.minimum.reduceat(((a * own + b) % PRIME)[at], starts)
    return out


def signatures(column: pa.Array, table: np.ndarray) -> np.ndarray:
    """A row of minima for each list of words; of an empty one PRIME. Each word of a piece is hashed once."""
    offsets = column.offsets.to_numpy()
    out = np.full((len(column), len(table)), PRIME, np.int64)
    row = 0
    while row < len(column):
        low, end = offsets[row], row + 1
        while end < len(column) and offsets[end + 1] - low <= PIECE:
            end += 1
        held = row + np.flatnonzero(np.diff(offsets[row : end + 1]))
        if end - row == 1:
            for part in range(low, offsets[end], PIECE):  # a long document
                out[row] = np.minimum(out[row], _minima(column.values[part : min(part + PIECE, offsets[end])], np.zeros(1, np.int64), table)[0])
        elif len(held):
            out[held] = _minima(column.values[low : offsets[end]], offsets[held] - low, table)
        row = end
    return out


def bands(docs: DataFrame, words: str, order: str, permutations: int = PERMUTATIONS, rows: int = ROWS) -> DataFrame:
    """(order, band, bucket) for each document that has words: MD5 over the `rows` minima of each band."""
    table = np.array(coefficients(permutations), np.int64)

    @F.arrow_udf("array<long>")
    def signature(column: pa.Array) -> pa.Array:
        minima = signatures(column, table)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(minima) + 1, dtype=np.int32) * len(table)), pa.array(minima.ravel()))

    signed = docs.filter(F.size(words) > 0).select(order, signature(F.col(words)).alias("s"))
    cut = F.transform(F.sequence(F.lit(0), F.lit(permutations // rows - 1)), lambda i: F.md5(F.array_join(F.transform(F.slice("s", i * rows + 1, rows), lambda v: v.cast("string")), ",")))
    return signed.select(order, F.posexplode(cut).alias("band", "bucket"))


def first_match(banded: DataFrame, order: str) -> DataFrame:
    """(order, first): the first earlier document that shares a bucket, for those that have one."""
    first = banded.groupBy("band", "bucket").agg(F.min(order).alias("first"))
    return banded.join(first, ["band", "bucket"]).filter(F.col("first") < F.col(order)).groupBy(order).agg(F.min("first").alias("first"))


def verified(matches: DataFrame, docs: DataFrame, words: str, order: str) -> DataFrame:
    """(order, first, jaccard): first_match()'s links with the exact Jaccard similarity of both documents' sets of words."""
    sets = docs.select(F.col(order).alias("_d"), F.array_distinct(words).alias("_w"))
    own = matches.join(sets.withColumnRenamed("_w", "_a"), F.col(order) == F.col("_d")).drop("_d")
    both = own.join(sets.withColumnRenamed("_w", "_b"), F.col("first") == F.col("_d")).drop("_d")
    common = F.size(F.array_intersect("_a", "_b"))
    return both.select(order, "first", (common / (F.size("_a") + F.size("_b") - common)).alias("jaccard"))


@functools.cache
def _own_dir() -> str:
    folder = tempfile.TemporaryDirectory(prefix="lexarbor-")
    atexit.register(folder.cleanup)
    return folder.name


def ensure_checkpoints(spark: SparkSession) -> None:
    """A checkpoint folder: the one that the session names; a temporary one only where all runs in one process."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or _own_dir())


def survivors(banded: DataFrame, order: str, rounds: int = 100) -> DataFrame:
    """(order): the documents that stay, as if read one by one in order: each one goes if it meets an earlier one that stayed.

    In a round, an open document goes if one of its buckets has an earlier one that stays, and stays if it is the first open one
    in all its buckets. The first open document of all is always decided, so rounds end; few are needed in practice.
    """
    ensure_checkpoints(banded.sparkSession)
    state = banded.select(F.col(order).alias("d"), F.xxhash64("band", "bucket").alias("b"), F.lit(None).cast("boolean").alias("stays")).checkpoint()
    for _ in range(rounds):
        seen = state.groupBy("b").agg(F.min(F.when(F.col("stays"), F.col("d"))).alias("kept"), F.min(F.when(F.col("stays").isNull(), F.col("d"))).alias("open"))
        told = state.filter("stays is null").join(seen, "b").groupBy("d").agg(F.max((F.coalesce(F.col("kept") < F.col("d"), F.lit(False))).cast("int")).alias("goes"), F.min((F.col("open") == F.col("d")).cast("int")).alias("leads"))
        decided = told.select("d", F.when(F.col("goes") == 1, False).when(F.col("leads") == 1, True).alias("now"))
        # what goes no longer matters to any bucket
        state = state.join(decided, "d", "left").select("d", "b", F.coalesce("stays", "now").alias("stays")).filter("stays is null or stays").checkpoint()
        if state.filter("stays is null").isEmpty():
            return state.select(F.col("d").alias(order)).distinct()
    raise RuntimeError(f"survivors: undecided documents after {rounds} rounds")
