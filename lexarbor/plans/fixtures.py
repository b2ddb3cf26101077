"""Inputs that the test tables lack, derived from them or from fixed rules, so that SQL can derive them, too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarbor.functions import text as tx
from lexarbor.operators import training
from lexarbor.sources import readers

LABELS = ["junk", "single", "listing"]
EVENT_MODELS = {
    "signup": "cerebras/qwen-3-235b-a22b-instruct-2507",
    "purchase": "deepseek/deepseek-v3.2",
    "error": "openai/gpt-oss-120b",
    "view": "google/gemma-4-31b-it",
    "click": "local/unpriced",
}
VOCABULARY = ["and", "the", "with", "of", "de", "la", "les", "und", "der", "nicht", "que", "los"]
LEMMAS = {"los": "el", "las": "el", "la": "el", "les": "le", "die": "der", "das": "der", "dem": "der"}
LEMMA_VOCABULARY = ["and", "the", "with", "of", "de", "el", "le", "und", "der", "nicht", "que"]
EMOJI = {"\U0001f600": ":grin:", "\U0001f468": ":man:", "\U0001f468\u200d\U0001f4bb": ":coder:"}
CONDITIONS, SEEDS, BASE = ["base", "tapt", "aug", "both"], [40, 41, 42, 43, 44], "base"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return readers.dealt(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generation records, one per event."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    model = F.create_map(*(F.lit(x) for pair in EVENT_MODELS.items() for x in pair))
    counts = F.struct((100 + i % 400).alias("prompt_tokens"), F.when(i % 13 != 0, 50 + i % 700).alias("completion_tokens"), (150 + i % 1100).alias("total_tokens"))
    return e.select(
        i.alias("record_id"), F.element_at(F.array(*(F.lit(x) for x in LABELS)), (i % 3 + 1).cast("int")).alias("label"), model[F.col("event_type")].alias("model"),
        F.round(0.3 + (i % 91) / 100, 2).alias("temperature"), F.when(i % 19 != 0, F.col("value") / 100).alias("latency_sec"), F.when(i % 17 != 0, counts).alias("tokens"),
        F.when(i % 23 != 0, F.concat(F.lit("record "), i.cast("string"))).alias("text"), (40 + i % 900).alias("text_length_chars"),
    )


GENERATED_SQL = (
    "select event_id as record_id, ['junk', 'single', 'listing'][(event_id % 3 + 1)::int] as label, case event_type "
    + " ".join(f"when '{k}' then '{v}'" for k, v in EVENT_MODELS.items())
    + " end as model, round(0.3::double + (event_id % 91)::double / 100, 2) as temperature, case when event_id % 19 <> 0 then value / 100 end as latency_sec,"
    " event_id % 17 <> 0 as has_tokens, 100 + event_id % 400 as prompt_tokens, case when event_id % 13 <> 0 then 50 + event_id % 700 end as completion_tokens,"
    " case when event_id % 23 <> 0 then 'record ' || event_id end as text, 40 + event_id % 900 as text_length_chars from events"
)


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, actual): classes from the labels."""
    actual = F.when(F.col("toxic") == 1, "junk").when(F.col("quality") == 1, "single").otherwise("listing")
    return table(spark, sf_dir, "labels").select("doc_id", actual.alias("actual"))


CLASSES_SQL = "select doc_id, case when toxic = 1 then 'junk' when quality = 1 then 'single' else 'listing' end as actual from labels"

#: What share of the rows each condition learns from, and which scores are compared with constants.
SHARES = dict(zip(CONDITIONS, (0.1, 0.2, 0.5, 1.0), strict=True))
CONSTANTS = {"f1_macro": 0.71, "f1_junk": 0.82}
EPOCHS = 10


def trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out predictions of nearest-centroid runs on the embeddings, by condition, seed and epoch."""
    return training.runs(table(spark, sf_dir, "embeddings"), "vec_id", "label", SHARES, SEEDS, EPOCHS)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.curves(training.scores(trained(spark, sf_dir)))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.metrics(training.scores(trained(spark, sf_dir)), F.col("label") == 0, "f1_junk")


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, actual, predicted) of one run when it has learned from everything."""
    last = training.runs(table(spark, sf_dir, "embeddings"), "vec_id", "label", {"both": 1.0}, [42], EPOCHS).filter(F.col("epoch") == EPOCHS)
    return last.select("vec_id", F.col("actual").cast("string").alias("actual"), F.col("predicted").cast("string").alias("predicted"))


CLASSES = [str(i) for i in range(10)]
_HASH = "('0x' || substr(md5({x}), 1, 8))::bigint / 4294967296.0::double"
TRAINED_SQL = f"""select s.seed, condition, epoch, vec_id, s.label as actual, arg_min(k.label, (list_distance(x, m), k.label)) as predicted
  from (select vec_id, label, embedding::double[] as x, seed, {_HASH.format(x="seed || ':' || vec_id")} as u from embeddings, (select unnest({SEEDS}) as seed)) s
  join (select seed, condition, epoch, label, list(m order by i) as m from (select seed, condition, epoch, label, i, avg(x[i]) as m from
      (select *, least({EPOCHS - 1}, floor((u - 0.2::double) / 0.8::double * {EPOCHS}))::int as step from (select label, embedding::double[] as x, seed, {_HASH.format(x="seed || ':' || vec_id")} as u, {_HASH.format(x="seed || ':share:' || vec_id")} as v from embeddings, (select unnest({SEEDS}) as seed)))
      join (values {", ".join(f"('{c}', {x}::double)" for c, x in SHARES.items())}) c(condition, share) on v < share, range(1, {EPOCHS + 1}) e(epoch), range(1, 65) d(i) where u >= 0.2 and step < epoch group by all) group by all) k on k.seed = s.seed
  where u < 0.2 group by all"""
SCORES_SQL = f"""select condition, seed, epoch, label, round(2 * sum(hit)::double / (sum(support) + sum(claimed)), 9) as f1 from (
  select condition, seed, epoch, actual as label, 1 as support, 0 as claimed, (actual = predicted)::int as hit from ({TRAINED_SQL}) union all select condition, seed, epoch, predicted, 0, 1, 0 from ({TRAINED_SQL})) group by all"""
RUNS_SQL = f"select condition, seed, list(f1 order by epoch) as curve from (select condition, seed, epoch, round(avg(f1), 6) as f1 from ({SCORES_SQL}) group by all) group by all"
METRICS_SQL = f"""select condition, seed, unnest(['f1_macro', 'f1_junk']) as metric, unnest([b.f1_macro, b.f1_junk]) as value from (select condition, seed, arg_max({{'f1_macro': f1_macro, 'f1_junk': f1_junk}}, (f1_macro, -epoch)) as b
  from (select condition, seed, epoch, round(avg(f1), 6) as f1_macro, coalesce(max(f1) filter (where label = 0), 0.0::double) as f1_junk from ({SCORES_SQL}) group by all) group by all)"""
JUDGED_SQL = f"select vec_id, actual::varchar as actual, predicted::varchar as predicted from ({TRAINED_SQL}) where condition = 'both' and seed = 42 and epoch = {EPOCHS}"


def inflected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, lemma, part): words of the documents that are another one of five letters or more and up to three more; the longest such other one stands for a lemma. part: 0 to 4 by hash."""
    words = table(spark, sf_dir, "documents").select(F.explode(tx.tokens(F.coalesce("text", F.lit("")))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).filter("length(word) >= 5").select("word")
    shorter = words.filter("length(word) >= 6").select("word", F.explode(F.filter(F.transform(F.array(*(F.lit(i) for i in (1, 2, 3))), lambda i: F.when(F.length("word") - i >= 5, F.left(F.col("word"), F.length("word") - i))), lambda x: x.isNotNull())).alias("lemma"))
    found = shorter.join(words.withColumnRenamed("word", "lemma"), "lemma").groupBy("word").agg(F.max("lemma").alias("lemma"))  # the longest is the greatest
    return found.withColumn("part", F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("long") % 5)
