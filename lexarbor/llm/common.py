"""What the operators share: scratch tables, a bounded id filter, row removal and connected components."""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of this bitmap table hold 32768 bits each.
BITMAP_BITS = 32768
#: Stands for a null id in joins; Spark's equality drops null keys.
NULL_ID = -(2**63)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@functools.cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="lexarbor-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A temporary one only where all run in one process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"file://{_local_dir()}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
    except Exception:  # the session has ended; the folder's owner clears it
        return


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver exits."""
    path = f"{shared_dir(spark).rstrip('/')}/lexarbor-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """df as a table written in the shared folder: cuts lineage and outlives lost executors."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


#: Rows that are worth a task of their own in narrow().
TASK_ROWS = 2000


def narrow(df: DataFrame, rows: int) -> DataFrame:
    """df in no more tasks than its counted rows are worth (8 at least): a small table isn't dealt over as many as a large one."""
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = max(8, rows // TASK_ROWS)
    return df.coalesce(wanted) if wanted < most else df


def dropped(*tables: DataFrame) -> None:
    """Removes tables that saved() wrote and nothing reads any more."""
    for table in tables:
        _remove(table.sparkSession, table.scratch)


def text_of(df: DataFrame, *ids: str, column: str = "text") -> DataFrame:
    """The id columns and the text (null: empty), whatever else df has."""
    return df.select(*(df[c].cast("long").alias(c) for c in ids), F.coalesce(df[column].cast("string"), F.lit("")).alias("text"))


def id_key(c: Column) -> Column:
    return F.coalesce(c.cast("long"), F.lit(NULL_ID))


class IdFilter:
    """A one-hash Bloom filter of longs as rows (bucket, 4 KB bitmap), built and probed by built-in functions.

    Its size is fixed by bits (at most 2^30: 128 MB), whatever the number of ids, so broadcasting it is safe;
    a full filter lets more rows through, never fewer. What passes still needs an exact join.
    """

    def __init__(self, ids: DataFrame, column: str, count: int | None = None):
        """count: the number of ids or more, if it is known; else they are counted."""
        count = ids.count() if count is None else count
        bits = 1 << min(30, max(20, (16 * max(1, count)).bit_length()))
        self.bits = bits
        pos = self._pos(F.col(column))
        self.rows = ids.select((pos / BITMAP_BITS).cast("int").alias("_bucket"), (pos % BITMAP_BITS).alias("_bit")).groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bitmap"))

    def _pos(self, c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(self.bits))

    def split(self, df: DataFrame, column: Column) -> DataFrame:
        """df with a boolean _maybe: false only for rows whose id isn't in the filter."""
        pos = self._pos(column)
        probe = df.withColumn("_bucket", (pos / BITMAP_BITS).cast("int")).join(F.broadcast(self.rows), "_bucket", "left")
        byte = F.conv(F.hex(F.expr("substring(_bitmap, _at, 1)")), 16, 10).cast("int")
        return (
            probe.withColumn("_at", ((pos % BITMAP_BITS) / 8).cast("int") + 1)
            .withColumn("_maybe", F.coalesce(byte.bitwiseAND(F.element_at(F.array(*(F.lit(1 << i) for i in range(8))), (pos % 8).cast("int") + 1)) != 0, F.lit(False)))
            .drop("_bucket", "_bitmap", "_at")
        )


def maybe(docs: DataFrame, ids: DataFrame, key: str = "_k") -> DataFrame:
    """The rows of docs (with a long column key) whose key may be among ids' key: a cheap cut before an exact join."""
    return IdFilter(ids, key).split(docs, F.col(key)).filter("_maybe").drop("_maybe")


def without_ids(docs: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """docs without the rows whose doc_id (null counts as an id of its own) is in the one-column table ids.

    Texts of rows that the id filter clears aren't shuffled; only the few others meet ids in an exact anti-join.
    Columns that start with an underscore and clash are kept apart by a struct.
    """
    names = docs.columns
    ids = ids.select(id_key(F.col(column)).alias("_k")).distinct()
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), id_key(F.col(f"`{column}`")).alias("_k"))
    split = IdFilter(ids, "_k").split(packed, F.col("_k"))
    kept = split.filter(~F.col("_maybe")).select("_row").unionByName(split.filter("_maybe").join(ids, "_k", "left_anti").select("_row"))
    return kept.select("_row.*")


def row_keys(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """df with the columns k1 and k2: 128 bits of hash of a row's id (null is no number) and its whole text (null: empty)."""
    told = (F.col(doc_id).isNull(), F.coalesce(F.col(doc_id).cast("long"), F.lit(0)), F.coalesce(F.col(text).cast("string"), F.lit("")))
    return df.withColumns({"k1": F.xxhash64(*told), "k2": F.xxhash64(F.lit(1), *told)})


def without_rows(docs: DataFrame, gone: DataFrame, once: DataFrame | None = None) -> DataFrame:
    """docs without the rows whose keys (k1, k2 of row_keys) are in the table gone; of those in once, one row of each key stays.

    Both are written tables of their distinct keys. A row goes for its own id and text, never for those of another one. Rows that the id filter clears
    aren't shuffled. All columns stay, whatever their names.
    """
    asked = gone.select("k1", "k2") if once is None else gone.select("k1", "k2").unionByName(once.select("k1", "k2"))
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("doc_id"), F.col("text"))
    split = IdFilter(asked, "k1").split(row_keys(packed).select("_row", "k1", "k2"), F.col("k1"))
    met = split.filter("_maybe").drop("_maybe").join(gone.select("k1", "k2"), ["k1", "k2"], "left_anti")
    kept = split.filter(~F.col("_maybe")).select("_row")
    if once is None or once.isEmpty():
        return kept.unionByName(met.select("_row")).select("_row.*")
    one = met.join(once.select("k1", "k2"), ["k1", "k2"]).groupBy("k1", "k2").agg(F.any_value("_row").alias("_row"))
    return kept.unionByName(met.join(once.select("k1", "k2"), ["k1", "k2"], "left_anti").select("_row")).unionByName(one.select("_row")).select("_row.*")


def least_hashed(rows: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """The n rows of least hash of their key, or all if there are fewer.

    Of many rows only those under a bound that about 2 n + 100 pass are ordered, so no task gets more than these.
    """
    total, hashed = rows.count(), rows.withColumn("_h", F.xxhash64(key))
    want = 2 * n + 100
    if total > want:
        hashed = hashed.filter(F.col("_h") < F.lit(-(2**63) + int(2**64 * want / total)))
    return hashed.orderBy("_h", key).limit(n).drop("_h")


#: Keys with more than a share of 1 / HOT_KEYS of all rows can't be more than HOT_KEYS.
HOT_KEYS = 10_000


def hot_limit(counts: DataFrame, n: str = "n") -> int:
    """How many rows a key of counts (one row a key, n rows of it) may have and be dealt by its hash.

    At most HOT_KEYS keys have more, whatever the data, so a table of these may be broadcast.
    """
    total = counts.agg(F.sum(n)).first()[0] or 0
    return max(100, total // HOT_KEYS)


def lookup(rows: DataFrame, table: DataFrame, key: str, n: str = "n", total: int | None = None) -> DataFrame:
    """rows joined with table (one row a key, which n rows have): hot keys by broadcast, the others by shuffle; without hot keys a plain join.

    Both should be written tables, as they are read twice. total: the sum of n, if it is known. Which keys are hot changes the plan, never the result.
    """
    told = table.agg(F.max(n).alias("most"), F.sum(n).alias("total")).first()
    limit = max(100, (total or told.total or 0) // HOT_KEYS)
    if (told.most or 0) <= limit:
        return rows.join(table, key)
    hot = F.broadcast(table.filter(F.col(n) > limit))
    cool = rows.join(hot.select(key), key, "left_anti").join(table.filter(F.col(n) <= limit), key)
    return rows.join(hot, key).unionByName(cool)


def dealt_join(rows: DataFrame, table: DataFrame, key: str, per: int = 2000) -> DataFrame:
    """rows joined with table, of which a key may have several rows, and in which no row is broadcast.

    rows of one key are dealt by a hash of all their columns into parts of about `per`, each of which meets a copy of the key's rows of table. Both should
    be written tables. Only how many parts a key has is looked up, by broadcast for the hottest (see lookup).
    """
    parts = rows.groupBy(key).agg(F.count("*").alias("_n")).join(table.select(key).distinct(), key).withColumn("_parts", F.ceil(F.col("_n") / per).cast("int"))
    parts = saved(parts, "parts")
    dealt = lookup(rows, parts, key, "_n").withColumn("_part", F.pmod(F.xxhash64(*rows.columns), F.col("_parts")).cast("int")).drop("_n", "_parts")
    copies = table.join(parts, key).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_n", "_parts")
    return dealt.join(copies, [key, "_part"]).drop("_part")


def bitmap(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """A table of 2^bits bits as bytes, on the driver: bit `key modulo 2^bits` is set for each key."""
    pos = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    rows = keys.select((pos / BITMAP_BITS).cast("int").alias("bucket"), (pos % BITMAP_BITS).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap")).toArrow()
    out = np.zeros(max(1 << bits, BITMAP_BITS) // 8, np.uint8)
    for bucket, raw in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
        out[bucket * 4096 : bucket * 4096 + 4096] = np.frombuffer(raw, np.uint8)
    return out


def probe(table: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    """Which of the 64-bit keys have their bit set in bitmap()'s table."""
    bit = keys & np.uint64((1 << bits) - 1)
    return (table[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _hung(hang: DataFrame):
    """Of (u, v), v the smaller: n rows, the most rows that a node is in, and whether all are stars of their smallest nodes, none in two (loose: how many nodes say no)."""
    ends = hang.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
    told = nodes.agg(F.sum("up").alias("n"), F.max("n").alias("most"), F.sum(((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("n") > 1))).cast("long")).alias("loose")).first()
    return told.n or 0, told.most or 0, told.loose or 0


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each connected component, for every node of edges (a, b: long, not null).

    Alternating large and small stars: every node hangs itself on the smallest neighbour until all that hangs together is one star. Where a node has
    many neighbours, minima are combined before they are shuffled, and what a hub tells its neighbours is broadcast (lookup), so no task gets a
    hub's edges. Where none has, a window over each node's rows tells the same in one job and three shuffles.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    hang = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    for _ in range(rounds):
        n, most, loose = _hung(hang)
        if not loose:
            roots = hang.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        hang, written = narrow(hang, n), []
        both = hang.unionByName(hang.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: larger neighbours of u go to u's smallest
        if most > max(100, 2 * n // HOT_KEYS):
            low = saved(narrow(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), n), "low")
            large = saved(narrow(lookup(both, low, "u", total=2 * n).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), n), "large")
            written = [low, large]
            met = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        else:
            large = both.withColumn("m", F.least("u", F.min("v").over(W.partitionBy("u")))).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            met = large.withColumn("m", F.min("v").over(W.partitionBy("u")))
        # small star: u and its smaller neighbours go to the smallest; u has few smaller ones, the smallest of each star
        small = met.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        hang = narrow(small, n).checkpoint()
        dropped(*written)
    raise RuntimeError(f"components: not settled after {rounds} rounds")
