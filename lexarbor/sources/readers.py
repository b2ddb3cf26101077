"""Scans. Every reader takes a declared schema; malformed rows are kept apart, not dropped silently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexarbor import schemas
from lexarbor.functions import text as tx


Schema = str | T.StructType


def struct(schema: Schema) -> T.StructType:
    return T._parse_datatype_string(schema) if isinstance(schema, str) else schema


def targets(spark: SparkSession, links: list[str], extra: list[dict] | None = None) -> DataFrame:
    """Crawl targets from links, named by the last segment, and further ones; of a name the first stays."""
    rows = [(i, None, link, None, None) for i, link in enumerate(links)] + [(len(links) + i, t["name"], t["entity"], t.get("topic_id"), t.get("limit")) for i, t in enumerate(extra or [])]
    made = spark.createDataFrame(rows, "i long, name string, entity string, topic_id long, limit long").withColumn("name", F.coalesce("name", tx.last_segment(F.col("entity"))))
    first = made.groupBy("name").agg(F.min_by(F.struct("entity", "topic_id", "limit"), "i").alias("t"))
    return first.select("name", "t.*")


def linked_targets(rows: DataFrame, link: str, order: str) -> DataFrame:
    """(name, entity) from a table of links, named by the last segment; of a name the first by `order` stays, links that are null are left out."""
    made = rows.filter(F.col(link).isNotNull()).select(tx.last_segment(F.col(link)).alias("name"), F.col(link).alias("entity"), order)
    return made.groupBy("name").agg(F.min_by("entity", order).alias("entity"))


def channel_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(posts, rejects) of a directory of JSON arrays, one file a channel, read recursively.

    Posts: channel (the file's stem), url, text, text_length; empty texts are left out. Rejects: files that don't parse.
    """
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path)
    raw = raw.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.json\z", "").alias("channel"), F.try_parse_json("value").alias("v"))
    listed = raw.withColumn("rows", F.try_variant_get("v", "$", "array<variant>"))
    posts = listed.filter("rows is not null").select("channel", F.explode("rows").alias("m"))
    posts = posts.select("channel", F.coalesce(F.try_variant_get("m", "$.url", "string"), F.lit("")).alias("url"), tx.strip(tx.flatten_post(F.to_json(F.try_variant_get("m", "$.text", "variant")))).alias("text"))
    rejects = listed.filter("rows is null").select("channel")
    return posts.filter("text <> ''").withColumn("text_length", tx.word_count(F.col("text"))), rejects


def csv(spark: SparkSession, path: str, schema: Schema) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def json_array(spark: SparkSession, path: str, schema: Schema) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def jsonl(spark: SparkSession, path: str, schema: Schema) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): blank lines are left out, lines that don't parse are the rejects."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    kept = T.StructType([*struct(schema).fields, T.StructField("_corrupt", T.StringType())])
    parsed = lines.select("value", F.from_json("value", kept, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    good = parsed.filter(F.col("r").isNotNull() & F.col("r._corrupt").isNull()).select("r.*").drop("_corrupt")
    return good, parsed.filter(F.col("r").isNull() | F.col("r._corrupt").isNotNull()).select("value")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(tx.strip(F.col("value")).alias("text")).filter("text <> ''")


def by_class(rows: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Rows of the known labels, flat: grouping is left to what follows."""
    return rows.filter(F.col("label").isin(labels or list(schemas.LABEL_CODES)))


def experiment(spark: SparkSession, path: str) -> DataFrame:
    """One row per run of experiment files: metadata and the run's fields."""
    return json_array(spark, path, schemas.EXPERIMENT).select("metadata", F.explode("runs").alias("run")).select("metadata", "run.*")


def report_value(report: Column, label: str, measure: str | None = None) -> Column:
    """A label's measure in a report, or a number that stands by itself; null where it is missing."""
    return F.try_variant_get(report, f"$['{label}']" + (f"['{measure}']" if measure else ""), "double")


def cartography(spark: SparkSession, path: str) -> DataFrame:
    """(id, history) from a file that maps ids to histories."""
    raw = spark.read.option("wholetext", True).text(path).select(F.from_json("value", schemas.CARTOGRAPHY).alias("m"))
    return raw.select(F.explode("m").alias("id", "v")).select("id", "v.history")


def dealt(rows: DataFrame) -> DataFrame:
    """A table of files smaller than one scan split, dealt over the cores: its few row groups would else be as many tasks. Larger ones as they are."""
    spark = rows.sparkSession
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    split = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))
    return rows.repartition(spark.sparkContext.defaultParallelism) if 1 << 20 < size <= split else rows
