"""The training-data pipeline: five stages over documents, each written as Parquet and read again by the next.

toxicity: documents predicted toxic go (the model is trained on the labels of the rows that come in).
exact_dedup: of equal texts the longest original stays, then the smallest doc_id.
near_dedup: of documents linked by five-word shingles with a Jaccard similarity of 0.8 or more, the one with the
smallest doc_id of each group stays.
decontaminate: documents of which a twentieth or more lies in 13-word windows of the benchmark go.
mix: documents are taken as often as their source's target asks; adds copies.

Every stage works on all that its predecessor kept. Every row is judged by its own id and text: what shares an id with it, or has none either,
doesn't matter. Of rows that are equal in both, one stays after dedup. Extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexarbor.llm import common, decontaminate, exact_dedup, jaccard, mixing, toxicity


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, common.read(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, common.read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
]

#: The first stage is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
