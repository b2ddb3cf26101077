"""Mixing sources to target weights by nested hash thresholds. DataFrame functions only.

Each source gets a target number of words. It takes all its documents as many whole times as fit, and for the rest
the documents whose 32-bit hash lies under a threshold. The threshold is found without sorting documents: words are
summed by source and by the hash's first bits, the running sum over these few buckets finds the one in which the
budget ends, and only that bucket is summed again by the next bits, down to single hash values. The last hash value is taken if that
ends nearer to the budget than leaving it.

The hash is of a row's id, its text and its number among the rows of its source that are equal in both, so rows that share an id, or have none, are told
apart, copies too. Only equal rows are numbered: within each part of the table, and then on over the parts, so no task gets them all.
A source ends within half of the words that share its boundary hash value (mostly one document). Null texts have no
words; a null source is a source of its own, last in order. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexarbor.llm import common

#: Bits of the 32-bit hash that each pass resolves.
LEVELS = (11, 11, 10)


def word_count(text: Column) -> Column:
    """The number of runs of other characters than ASCII whitespace: a run begins where whitespace, or nothing, is before it."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")).cast("long")


def digest(doc_id: Column, text: Column) -> Column:
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text.cast("string"), F.lit(""))))


def hash32(digest_: Column, number: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat(digest_, F.lit(":"), number.cast("string"))), 1, 8), 16, 10).cast("long")


def repeated(rows: DataFrame) -> DataFrame:
    """(key, digest) of which rows has several, written."""
    return common.saved(rows.groupBy("key", "digest").agg(F.count("*").alias("n")).filter("n > 1").select("key", "digest"), "repeated")


def hashed(rows: DataFrame, twice: DataFrame) -> DataFrame:
    """rows with their hash h: of digest and number, which is 0 for all (key, digest) but those in twice."""
    same = F.xxhash64("key", "digest")
    if twice.isEmpty():
        return rows.withColumn("h", hash32(F.col("digest"), F.lit(0)))
    split = common.IdFilter(twice.select(same.alias("_k")), "_k").split(rows, same)
    alone = split.filter("not _maybe").drop("_maybe").withColumn("h", hash32(F.col("digest"), F.lit(0)))
    some = common.saved(split.filter("_maybe").drop("_maybe").withColumn("_part", F.spark_partition_id()), "some")
    equal = W.partitionBy("key", "digest", "_part")
    parts = some.groupBy("key", "digest", "_part").agg(F.count("*").alias("_n"))
    parts = parts.withColumn("_before", F.sum("_n").over(W.partitionBy("key", "digest").orderBy("_part").rowsBetween(W.unboundedPreceding, -1))).drop("_n")
    local = some.withColumn("_i", F.row_number().over(equal.orderBy(F.lit(0))) - 1)
    numbered = local.join(parts, ["key", "digest", "_part"]).withColumn("h", hash32(F.col("digest"), F.col("_i") + F.coalesce("_before", F.lit(0))))
    return alone.unionByName(numbered.drop("_part", "_i", "_before"))


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, key, source_size, target) from (source, key, source_size).

    Sources in code point order, null last, weigh as weights say, in turn. They share `share` times all words by
    weight; a target stops at `most` times its source, and what it can't take goes to the others by weight: the
    targets are min(most * size, weight * level) for the one level at which they add up.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("_i", F.row_number().over(order) - 1)
    ranked = ranked.withColumn("_w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("_i") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("_cap", most * F.col("source_size").cast("double")).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    by_ratio = W.orderBy("_ratio", "_i")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    level = ranked.withColumn("_total", F.sum("source_size").over(W.partitionBy(F.lit(1))).cast("double") * share)
    level = level.withColumn("_full", most * F.coalesce(F.sum("source_size").over(before), F.lit(0)).cast("double"))
    level = level.withColumn("_left", F.sum("_w").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
    level = level.withColumn("_level", (F.col("_total") - F.col("_full")) / F.col("_left"))
    # sources in order of their ratio are full while the level that the others could reach is above them; the first that isn't gives the level of the rest
    found = level.withColumn("_open", F.first(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level")), True).over(by_ratio.rowsBetween(W.unboundedPreceding, 0)))
    return found.select("source", "key", "source_size", F.when(F.col("_open").isNotNull(), F.col("_w") * F.col("_open")).otherwise(F.col("_cap")).alias("target"))


def source_key(source: Column) -> Column:
    """Never null, and apart for null and empty sources."""
    return F.concat(F.when(source.isNull(), "n").otherwise("s"), F.coalesce(source.cast("string"), F.lit("")))


def sizes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, key, size, h), written in the shared folder, the texts being read once; and what repeated() tells of them."""
    sized = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), source_key(docs["source"]).alias("key"),
        word_count(F.coalesce(docs["text"].cast("string"), F.lit(""))).alias("size"), digest(docs["doc_id"].cast("long"), docs["text"]).alias("digest"),
    )
    sized = common.saved(sized, "digests")
    twice = repeated(sized)
    return common.saved(hashed(sized, twice).drop("digest"), "sized"), twice


def thresholds(sized: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(key, source_size, target, whole, under): a document is taken whole times, and once more if its hash is under."""
    goals = targets(sized.groupBy("source", "key").agg(F.sum("size").alias("source_size")), weights, share, most)
    goals = goals.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goals = common.saved(goals.select("key", "source_size", "target", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("left")), "goals")

    # the bucket in which each source's budget ends, level by level; low: first hash value that isn't taken yet
    ends, bits = goals.select("key", "left", F.lit(0).cast("long").alias("low")), 32
    for level in LEVELS:
        width = 1 << bits
        bits -= level
        step = 1 << bits
        inside = sized.join(_small(ends), "key").filter((F.col("h") >= F.col("low")) & (F.col("h") < F.col("low") + width))
        sums = inside.groupBy("key", "left", "low", ((F.col("h") - F.col("low")) / step).cast("long").alias("bucket")).agg(F.sum("size").alias("words"))
        running = sums.withColumn("sum", F.sum("words").over(W.partitionBy("key").orderBy("bucket")))
        # the first bucket that goes beyond what is left; the last one where rounding lets none
        at = running.groupBy("key", "left", "low").agg(F.coalesce(F.min(F.when(F.col("sum") > F.col("left"), F.struct("bucket", "sum", "words"))), F.max(F.struct("bucket", "sum", "words"))).alias("at"))
        ends = common.saved(at.select("key", (F.col("left") - (F.col("at.sum") - F.col("at.words"))).alias("left"), (F.col("low") + F.col("at.bucket") * step).alias("low"), F.col("at.words").alias("words")), "ends")
    # low is a single hash value by now: take it too if that ends nearer to the budget (a tie leaves it)
    ends = ends.select("key", F.when(F.col("words") < 2 * F.col("left"), F.col("low") + 1).otherwise(F.col("low")).alias("under"))
    return common.saved(goals.drop("left").join(ends, "key"), "thresholds")


def _small(per_source: DataFrame, rows: int = 100_000) -> DataFrame:
    """For a join by source: broadcast where the sources, by count, are few; else AQE chooses and splits hot ones."""
    return F.broadcast(per_source) if per_source.count() <= rows else per_source


def _copies() -> Column:
    return F.col("whole") + F.when(F.col("h") < F.col("under"), 1).otherwise(0)


def mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words, repeats counted)."""
    sized, _ = sizes(docs)
    return sized.join(_small(thresholds(sized, weights, share, most)), "key").select("doc_id", "size", "source_size", "target", (F.col("size") * _copies()).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The documents that the mix takes, all columns, and copies: how often (a column of that name is replaced)."""
    sized, twice = sizes(docs)
    plan = thresholds(sized, weights, share, most)
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "copies")).alias("_row"), source_key(docs["source"]).alias("key"), digest(docs["doc_id"].cast("long"), docs["text"]).alias("digest"))
    return hashed(packed, twice).join(_small(plan), "key").withColumn("copies", _copies().cast("int")).filter("copies > 0").select("_row.*", "copies")
