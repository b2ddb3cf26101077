"""Generated records: flattening, cost and speed, the per-model benchmark, quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# USD per million tokens, in and out; weights of the models in a draw; records wanted of each label.
PRICES = {
    "cerebras/qwen-3-235b-a22b-instruct-2507": (0.6, 1.2),
    "deepseek/deepseek-v3.2": (0.252, 0.378),
    "nvidia/nemotron-3-super-120b-a12b:free": (0.0, 0.0),
    "openai/gpt-oss-120b": (0.039, 0.18),
    "meta-llama/llama-3.3-70b-instruct": (0.10, 0.32),
    "google/gemma-4-31b-it": (0.13, 0.38),
    "minimax/minimax-m2.7": (0.299, 1.20),
    "google/gemini-3-flash-preview": (0.5, 3.0),
}
MODEL_WEIGHTS = {
    "cerebras/qwen-3-235b-a22b-instruct-2507": 0.20,
    "deepseek/deepseek-v3.2": 0.15,
    "nvidia/nemotron-3-super-120b-a12b:free": 0.15,
    "openai/gpt-oss-120b": 0.15,
    "meta-llama/llama-3.3-70b-instruct": 0.10,
    "google/gemma-4-31b-it": 0.10,
    "minimax/minimax-m2.7": 0.10,
    "google/gemini-3-flash-preview": 0.05,
}
QUOTAS = {"junk": 2333, "single": 2333, "listing": 2334}


def price_table(spark, prices: dict[str, tuple[float, float]] = PRICES) -> DataFrame:
    return spark.createDataFrame([(m, i, o) for m, (i, o) in prices.items()], "model string, price_in double, price_out double")


def flatten_tokens(records: DataFrame) -> DataFrame:
    """Token counts as columns: a missing count of a present struct is 0, of an absent one null."""
    out = records
    for c in ("prompt_tokens", "completion_tokens", "total_tokens"):
        out = out.withColumn(c, F.when(F.col("tokens").isNotNull(), F.coalesce(F.col(f"tokens.{c}"), F.lit(0))))
    return out.drop("tokens")


def speed_and_cost(records: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds tps (null without a latency) and cost_usd (0 for models without a price). The price table has a row a model."""
    tps = F.when(F.col("latency_sec").isNotNull(), F.col("completion_tokens") / F.greatest(F.col("latency_sec"), F.lit(0.001)))
    priced = records.withColumn("tps", tps).join(prices, "model", "left")
    cost = F.col("prompt_tokens") / 1e6 * F.col("price_in") + F.col("completion_tokens") / 1e6 * F.col("price_out")
    return priced.withColumn("cost_usd", F.when(F.col("price_in").isNull(), 0.0).otherwise(cost)).drop("price_in", "price_out")


def benchmark(records: DataFrame) -> DataFrame:
    """One row per model: records, mean temperature, latency, length and tps, total cost."""
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return records.filter("model is not null").groupBy("model").agg(
        F.count("label").alias("records_count"), mean("temperature", "avg_temperature"), mean("latency_sec", "avg_latency_sec"), mean("text_length_chars", "avg_text_length"), mean("tps", "avg_tps"), F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6).alias("total_cost_usd")
    )


#: The columns of a benchmark that a reader is shown.
SHOWN = ["model", "records_count", "avg_latency_sec", "avg_tps", "total_cost_usd", "diversity_score"]


def displayed(summary: DataFrame) -> DataFrame:
    """The six columns that are shown, most diverse models first."""
    return ranked(summary).select(SHOWN)


def captured(records: DataFrame) -> DataFrame:
    """Latencies as they are recorded: seconds with two decimals."""
    return records.withColumn("latency_sec", F.round("latency_sec", 2))


def ranked(summary: DataFrame) -> DataFrame:
    """Most diverse models first, those without a score last."""
    return summary.orderBy(F.desc_nulls_last("diversity_score"), "model")


def with_diversity(summary: DataFrame, bleu: DataFrame) -> DataFrame:
    return summary.join(bleu.select("model", "self_bleu"), "model", "left").withColumn("diversity_score", 1 - F.col("self_bleu"))


def valid(records: DataFrame) -> DataFrame:
    """Records that have a text."""
    return records.filter(F.col("text").isNotNull())


def progress(records: DataFrame, quotas: dict[str, int] = QUOTAS) -> DataFrame:
    """(label, have, remaining) of the labels that have a quota; a full one has 0 left."""
    spark = records.sparkSession
    want = spark.createDataFrame(list(quotas.items()), "label string, quota long")
    have = records.filter(F.col("label").isin(list(quotas))).groupBy("label").agg(F.count("*").alias("have"))
    return F.broadcast(want).join(have, "label", "left").select("label", F.coalesce("have", F.lit(0)).alias("have"), F.greatest(F.lit(0), F.col("quota") - F.coalesce("have", F.lit(0))).alias("remaining"))
