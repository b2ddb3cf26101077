"""Streams: posts that arrive as files, and generation until quotas are full.

A file stream stands for the crawl: its checkpoint is what resumes it, and a target's files come in order of their time.
Generated records go through foreachBatch: bad ones to a reject table with a bounded number of tries, good ones up to
each label's quota to the sink, exactly once by the record's key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lexarbor.functions import text as tx
from lexarbor.operators import generation, sampling
from lexarbor.sources import readers


def posts(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """A stream of posts from JSON files, without empty texts and repeats by URL within a day of arrival."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)
    kept = raw.withColumn("text", tx.strip(F.col("text"))).filter("text <> ''").withColumn("arrived", F.current_timestamp())
    return kept.withWatermark("arrived", "1 day").dropDuplicatesWithinWatermark(["url"])


def windowed_counts(events: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by event-time window and kind; rows later than the watermark are dropped by it."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count("*").alias("n"))


def take_open(batch: DataFrame, done: DataFrame, key: str, quotas: dict[str, int]) -> DataFrame:
    """The records of a batch that the sink lacks and its quotas (a row a label) still want, first by key."""
    new = batch.dropDuplicates([key]).join(done.select(key), key, "left_anti")
    return _first(new, generation.progress(done, quotas).select("label", "remaining"), key)


def resume(spark: SparkSession, path: str, schema: str | T.StructType, quotas: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, rejects, progress) of a JSONL checkpoint: lines that parse and have a text and a label with a quota, lines that
    don't parse, and what each quota still wants. A checkpoint without rows resumes from nothing."""
    quotas = quotas or generation.QUOTAS
    rows, rejects = readers.jsonl(spark, path, schema)
    records = generation.valid(rows).filter(F.col("label").isin(list(quotas)))
    return records, rejects, generation.progress(records, quotas)


#: Parts of a label that are ranked by themselves before the ranks of a whole label are made.
PARTS = 64


def _first(new: DataFrame, want: DataFrame, key: str) -> DataFrame:
    """The `remaining` records of each label that are first by key: within parts of a label, then of what those leave, so that
    no task ranks more than a 64th of a label or 64 times its quota."""
    part = F.pmod(F.xxhash64(key), F.lit(PARTS))
    near = new.join(F.broadcast(want), "label").withColumn("_r", F.row_number().over(W.partitionBy("label", part).orderBy(key))).filter("_r <= remaining")
    return near.withColumn("_r", F.row_number().over(W.partitionBy("label").orderBy(key))).filter("_r <= remaining").drop("_r", "remaining")


def fill_quotas(stream: DataFrame, sink: str, rejects: str, checkpoint: str, key: str, quotas: dict[str, int] | None = None, available_now: bool = True) -> StreamingQuery:
    """Writes valid records to the sink (Parquet, partitioned by batch) until each label has its quota; those without text go to rejects.

    A batch that is run again writes to the same folder again, so a lost driver repeats no record. What earlier batches wrote is
    one table: its keys and labels alone are read, batches listed once by the reader, and once all quotas are full not even these.
    """
    quotas = quotas or generation.QUOTAS
    columns = T.StructType(stream.schema.fields)
    state = {}

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(sink)
        held = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        batch.filter(F.col("text").isNull()).write.mode("overwrite").parquet(f"{rejects}/batch={number}")
        if state.get("full_since", number) < number:
            return
        done = spark.read.schema(T.StructType([*columns.fields, T.StructField("batch", T.LongType())])).option("basePath", sink).parquet(sink).filter(F.col("batch") < number) if held else spark.createDataFrame([], columns)
        take_open(generation.valid(batch), done.select(key, "label"), key, quotas).write.mode("overwrite").parquet(f"{sink}/batch={number}")
        if held and generation.progress(done, quotas).filter("remaining > 0").isEmpty():
            state["full_since"] = number

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def template_generator(seed: int) -> Callable[[DataFrame, str, str], DataFrame]:
    """Stands for a language model where there is no network: a text that depends on the prompt and the seed only."""

    def generate(rows: DataFrame, key: str, prompt: str) -> DataFrame:
        ending = sampling.choice(["See you there.", "Join us.", "Doors open at seven."], seed, F.col(key))
        return rows.withColumn("text", F.concat(F.col(prompt), F.lit(" "), ending)).withColumn("text_length_chars", F.length("text"))

    return generate


def with_retries(rows: DataFrame, generate: Callable[[DataFrame, int], DataFrame], key: str, tries: int = 3) -> tuple[DataFrame, DataFrame]:
    """(records, rejects): generate(rows, attempt) gives text or null; rows that fail are tried again, a bounded number of times."""
    left, good = rows, None
    for attempt in range(tries):
        made = generate(left, attempt)
        ok = generation.valid(made)
        good = ok if good is None else good.unionByName(ok)
        left = left.join(ok.select(key), key, "left_anti")
    return good, left
