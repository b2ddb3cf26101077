"""Exact dedup by a log-structured merge index of text digests. DataFrame functions only.

The rows are dealt to memtables by the task that read them. A memtable is combined by digest and flushed as a run: a Parquet table
sorted by digest (with its min/max statistics) and a bitmap filter of its digests beside it. When
FANOUT runs of a level are there, they are compacted into one of the next level, written again: digests that no other run's filter
knows go through as they are, without a shuffle, and the others are merged, keeping of each digest the row that stays and the number of rows.
A lookup asks only those runs whose filter lets a digest pass; its hits are merged over the runs.

Every row that doesn't stay is a hit, and a hit counts only after its normalised text has been compared byte for byte with
that of the row that stays; hits that differ (a digest collision) are grouped by their text instead.

Null texts count as empty and equal each other. Of equal texts of one length the smallest doc_id stays, null last, and of repeated rows
one, whichever: exactly one row of a group is kept. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexarbor.llm import common

#: Rows of a digest that are compared with one copy of the text that stays; larger groups are salted.
SALT_ROWS = 256


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


#: Memtables that the rows are dealt to, and runs of a level that are compacted into one.
MEMTABLES, FANOUT = 4, 2

def rank() -> Column:
    """What stays is the smallest of these: the longest text, then the smallest doc_id, then any one row."""
    return F.struct((-F.col("size")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id", "row")


class Run:
    """A sorted table (digest, stays, n) in the shared folder, its level and the filter of its digests."""

    def __init__(self, entries: DataFrame, level: int, rows: int):
        """rows: how many entries there are at most, for the filter's size."""
        self.level, self.rows, spark = level, rows, entries.sparkSession
        path = common.scratch_path(spark, f"run-{level}")
        entries.select("digest", "stays", "n").sortWithinPartitions("digest").write.parquet(path)
        self.table = spark.read.schema(entries.select("digest", "stays", "n").schema).parquet(path)
        self.table.scratch = path
        self.filter = common.IdFilter(self.table.select(F.xxhash64("digest").alias("h")), "h", rows)

    def known(self, rows: DataFrame) -> DataFrame:
        """rows with _maybe: false where this run doesn't hold the digest for sure."""
        return self.filter.split(rows, F.xxhash64("digest"))


class LsmIndex:
    """Runs of digests by level. merged, if counted: how many digests compactions had to merge by shuffle, and how many passed by the filters."""

    def __init__(self, fanout: int = FANOUT, counted: bool = False):
        self.fanout, self.runs, self.counted, self.merged = fanout, [], counted, (0, 0)

    def flush(self, memtable: DataFrame, rows: int | None = None) -> None:
        """Adds the rows (digest, doc_id, size, row), `rows` at most, as a run and compacts levels that are full."""
        rows = memtable.count() if rows is None else rows
        self.runs.append(Run(memtable.groupBy("digest").agg(F.min(rank()).alias("stays"), F.count("*").alias("n")), 0, rows))
        while sum(r.level == self.runs[-1].level for r in self.runs) >= self.fanout:
            self.compact(self.runs[-1].level)

    def compact(self, level: int | None = None) -> None:
        """Merges the runs of a level, or all, into one of the next."""
        runs = [r for r in self.runs if level is None or r.level == level]
        if len(runs) < 2:
            return
        alone = shared = None
        for run in runs:
            rows = run.table.withColumn("_shared", F.lit(False))
            for other in runs:
                if other is not run:
                    rows = other.known(rows).withColumn("_shared", F.col("_shared") | F.col("_maybe")).drop("_maybe")
            rows = common.saved(rows, "sifted")
            one, more = rows.filter("not _shared").drop("_shared"), rows.filter("_shared").drop("_shared")
            alone, shared = (one, more) if alone is None else (alone.unionByName(one), shared.unionByName(more))
        if self.counted:
            self.merged = (self.merged[0] + shared.count(), self.merged[1] + alone.count())
        shared = shared.groupBy("digest").agg(F.min("stays").alias("stays"), F.sum("n").alias("n"))
        self.runs = [r for r in self.runs if r not in runs] + [Run(alone.unionByName(shared), max(r.level for r in runs) + 1, sum(r.rows for r in runs))]
        for run in runs:
            common.dropped(run.table)

    def lookup(self, digests: DataFrame) -> DataFrame:
        """(digest, stays, n, asked) of the distinct digests of a written table, over all runs; asked: the runs that a filter let pass."""
        digests, hits = digests.select("digest").distinct(), None
        for run in self.runs:
            asked = run.known(digests).filter("_maybe").drop("_maybe").join(run.table, "digest", "left")
            hits = asked if hits is None else hits.unionByName(asked)
        return hits.groupBy("digest").agg(F.min("stays").alias("stays"), F.sum("n").alias("n"), F.count("*").alias("asked")).filter("n is not null")


def report(docs: DataFrame, digest: Callable[[Column], Column] = sha256, memtables: int = MEMTABLES, fanout: int = FANOUT) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (and size, in code points).

    Of equal texts (after deleting ASCII whitespace) the longest original stays, then the smallest doc_id. Any digest
    gives the same result; a weak one only means more comparisons that fail.
    """
    texts = common.text_of(docs, "doc_id").select("doc_id", F.length("text").alias("size"), normalised(F.col("text")).alias("norm"))
    entries = texts.select(F.monotonically_increasing_id().alias("row"), F.spark_partition_id().alias("task"), digest(F.col("norm")).alias("digest"), "doc_id", "size", sha256(F.col("norm")).alias("sha"))
    entries = common.saved(entries, "entries")
    index, sizes = LsmIndex(fanout), {r.m: r.n for r in entries.groupBy((F.col("task") % memtables).alias("m")).agg(F.count("*").alias("n")).collect()}
    for m in range(memtables):
        index.flush(entries.filter(F.col("task") % memtables == m), sizes.get(m, 0))
    index.compact()
    # digests of one row are in no group: only the others are looked up
    groups = common.saved(index.runs[0].table.filter("n > 1"), "groups")
    sifted = common.IdFilter(groups.select(F.xxhash64("digest").alias("h")), "h", sum(sizes.values()) // 2).split(entries, F.xxhash64("digest"))
    several = common.saved(sifted.filter("_maybe").drop("_maybe"), "several")
    hits = common.saved(common.lookup(several, groups, "digest"), "hits")
    differ = common.saved(_differ(texts, hits, digest), "differ")
    if not differ.isEmpty():
        hits = common.saved(_regrouped(hits, differ), "regrouped")
    alone = sifted.filter("not _maybe").drop("_maybe")
    # what the filter let pass though it is in no group
    alone = alone.unionByName(several.join(hits.select("row"), "row", "left_anti"))
    told = hits.select("doc_id", F.col("stays.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("stays.row")).alias("kept"), "sha", "size")
    told = told.unionByName(alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha", "size"))
    return told.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"), "size")


def _differ(texts: DataFrame, hits: DataFrame, digest) -> DataFrame:
    """(doc_id, size, digest, norm) of the hits whose text isn't that of the row that stays."""
    ids = hits.select(common.id_key(F.col("doc_id")).alias("_k"), "digest", "size", F.col("stays.doc_id").alias("keep_id"), (-F.col("stays.less")).alias("keep_size"), "n").distinct()
    moved = common.maybe(texts.withColumn("_k", common.id_key(F.col("doc_id"))), hits.select(common.id_key(F.col("doc_id")).alias("_k")).distinct())
    moved = moved.withColumn("digest", digest(F.col("norm"))).join(ids, ["_k", "digest", "size"])
    salts = F.ceil(F.col("n") / SALT_ROWS).cast("int")
    stays = moved.filter(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("size") == F.col("keep_size")))
    stays = stays.select("digest", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.col("norm").alias("stays"))
    others = moved.withColumn("salt", F.pmod(F.xxhash64("_k"), salts).cast("int"))
    # several rows may claim to stay (a repeated doc_id): a text is sound if it equals the first of them
    stays = stays.groupBy("digest", "salt").agg(F.min("stays").alias("stays"))
    return others.join(stays, ["digest", "salt"]).filter("norm <> stays").select("doc_id", "size", "digest", "norm")


def _regrouped(hits: DataFrame, differ: DataFrame) -> DataFrame:
    """hits, where the texts of a digest differ: rows equal to the one that stays are a group, others by text."""
    keyed = hits.drop("stays", "n").withColumn("_k", common.id_key(F.col("doc_id"))).join(differ.select(common.id_key(F.col("doc_id")).alias("_k"), "digest", "size", "norm").distinct(), ["_k", "digest", "size"], "left")
    groups = keyed.groupBy("digest", F.col("norm").alias("other")).agg(F.min(rank()).alias("stays"), F.count("*").alias("n")).withColumnRenamed("digest", "_d")
    return keyed.join(groups, (F.col("digest") == F.col("_d")) & F.col("norm").eqNullSafe(F.col("other"))).drop("_k", "norm", "_d", "other")


def deduplicate(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The rows of docs that stay, all columns; of repeated rows one. Texts that stay aren't shuffled."""
    names = docs.columns
    told = common.saved(report(docs, digest).select(common.id_key(F.col("doc_id")).alias("_k"), "kept", "text_sha256"), "told")
    twice = told.groupBy("_k").count().filter("count > 1").select("_k")
    plain = common.without_ids(docs, told.filter("not kept").select("_k").union(twice).select(F.col("_k").alias("doc_id")))
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), common.id_key(docs["doc_id"]).alias("_k"), F.lower(F.hex(sha256(normalised(F.coalesce(docs["text"], F.lit("")))))).alias("_sha"), F.length(F.coalesce(docs["text"], F.lit(""))).alias("_size"))
    again = common.maybe(packed, twice).join(told.filter("kept").select("_k", F.col("text_sha256").alias("_sha")).join(twice, "_k", "left_semi").distinct(), ["_k", "_sha"], "left_semi")
    best = again.groupBy("_k", "_sha").agg(F.max_by("_row", "_size").alias("_row"))
    return plain.unionByName(best.select("_row.*"))
