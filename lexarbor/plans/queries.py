"""The registered queries: each applies operators to whole test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarbor.functions import stats
from lexarbor.functions import text as tx
from lexarbor.functions import vocabulary
from lexarbor.operators import corpus, dedup, diversity, evaluation, features, generation, leakage, lemmas, linear, maps, masked, ml, network, prompts, sampling, similarity
from lexarbor.plans import fixtures as fx
from lexarbor.plans.fixtures import table

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _six(c: str):
    return F.round(c, 6).alias(c)


@query
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.clean(F.col("text")).alias("clean_text"))


@query
def html_flatten(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", tx.clean(F.col("html")).alias("clean_text"))


@query
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return corpus.stats(table(spark, d, "documents"), "source")


@query
def corpus_overview(spark: SparkSession, d: str) -> DataFrame:
    return corpus.overview(table(spark, d, "documents"), "source")


@query
def newest_posts(spark: SparkSession, d: str) -> DataFrame:
    return corpus.newest(table(spark, d, "events"), "event_type", "ts", "event_id", 200).select("event_type", "event_id")


@query
def length_filter(spark: SparkSession, d: str) -> DataFrame:
    kept = corpus.cleaned(table(spark, d, "documents"))
    return kept.groupBy("source").agg(F.count("*").alias("n_docs"), F.round(F.avg("word_count"), 6).alias("mean_words"))


@query
def relevance_score(spark: SparkSession, d: str) -> DataFrame:
    return corpus.relevant(corpus.cleaned(table(spark, d, "documents")), fx.VOCABULARY).select("doc_id", "score")


@query
def keyword_relevance(spark: SparkSession, d: str) -> DataFrame:
    kept = corpus.cleaned(table(spark, d, "pages").withColumnRenamed("html", "text"))
    return corpus.relevant(kept, vocabulary.lemma_set(vocabulary.CORRECTED), least=0).select("page_id", "score")


@query
def relevance_lemmas(spark: SparkSession, d: str) -> DataFrame:
    dictionary = spark.createDataFrame(list(fx.LEMMAS.items()), "word string, lemma string")
    return corpus.relevant_by_table(corpus.cleaned(table(spark, d, "documents")), fx.LEMMA_VOCABULARY, dictionary).select("doc_id", "score")


@query
def emoji_names(spark: SparkSession, d: str) -> DataFrame:
    marks = F.array(*(F.lit(e) for e in fx.EMOJI))
    text = F.concat(F.element_at(marks, (F.col("turn") % 3 + 1).cast("int")), F.coalesce("text", F.lit("")), F.element_at(marks, (F.col("conv_id") % 3 + 1).cast("int")))
    return table(spark, d, "conversations").select("conv_id", "turn", tx.demojize(text, fx.EMOJI).alias("text"))


@query
def truncated_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.truncated(F.coalesce("text", F.lit("")), 128).alias("text"))


@query
def text_hash(spark: SparkSession, d: str) -> DataFrame:
    hashed = table(spark, d, "documents").select("doc_id", tx.text_hash(F.col("text")).alias("hash"))
    return hashed.groupBy("hash").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))


@query
def exact_leak_url(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    return leakage.without_urls(pages, pages.filter(F.contains(F.col("url"), F.lit("/de/")))).select("page_id")


@query
def exact_leak_text(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return leakage.without_texts(docs.filter("source <> 'src0'"), docs.filter("source = 'src0'")).select("doc_id")


@query
def fuzzy_leak(spark: SparkSession, d: str) -> DataFrame:
    best = leakage.similarity(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id")
    return best.select("doc_id", _six("max_cosine"), (F.round("max_cosine", 6) >= leakage.THRESHOLD).alias("leaks"))


@query
def decontaminate(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    golden = docs.filter("source = 'src0'").select(F.col("doc_id").alias("item_id"), F.concat("text", F.lit(" the end")).alias("text"))
    return leakage.decontaminate(docs, golden, "doc_id", "item_id").select("doc_id")


def _words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.tokens(F.coalesce("text", F.lit(""))).alias("words"))


def _banded(spark: SparkSession, d: str) -> DataFrame:
    return dedup.bands(_words(spark, d), "words", "doc_id")


@query
def minhash_bands(spark: SparkSession, d: str) -> DataFrame:
    return _banded(spark, d)


@query
def near_dup_first_match(spark: SparkSession, d: str) -> DataFrame:
    return dedup.first_match(_banded(spark, d), "doc_id")


@query
def near_dup_verified(spark: SparkSession, d: str) -> DataFrame:
    links = dedup.verified(dedup.first_match(_banded(spark, d), "doc_id"), _words(spark, d), "words", "doc_id")
    return links.select("doc_id", "first", _six("jaccard"), (F.round("jaccard", 6) >= 0.85).alias("near"))


@query
def near_dup_survivors(spark: SparkSession, d: str) -> DataFrame:
    return dedup.survivors(_banded(spark, d), "doc_id")


@query
def top_bigrams(spark: SparkSession, d: str) -> DataFrame:
    return corpus.top_ngrams(table(spark, d, "documents")).select("rank", "term", "n")


@query
def bigram_compare(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return corpus.compare_top(docs.filter("lang = 'en'"), docs.filter("lang = 'fr'"))


@query
def tfidf_terms(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    terms = features.chosen(features.frequencies(docs, "doc_id", 1, 1), docs.count(), min_df=3, max_df=0.8)
    return features.weighted(docs, terms, "doc_id", 1, 1, sublinear=True).select("doc_id", "term", _six("w"))


@query
def char_gram_df(spark: SparkSession, d: str) -> DataFrame:
    grams = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(tx.char_wb_ngrams(F.coalesce("text", F.lit(""))))).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("df"))


@query
def label_balance(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.class_weights(fx.classes(spark, d), "actual").select("actual", "n", _six("weight"))


@query
def label_encode(spark: SparkSession, d: str) -> DataFrame:
    from lexarbor import schemas

    return fx.classes(spark, d).select("doc_id", evaluation.label_code(F.col("actual"), schemas.LABEL_CODES).alias("code"))


@query
def confusion(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.confusion(fx.judged(spark, d), fx.CLASSES)


@query
def class_report(spark: SparkSession, d: str) -> DataFrame:
    told = evaluation.report(evaluation.confusion(fx.judged(spark, d), fx.CLASSES))
    return told.select("label", _six("precision"), _six("recall"), _six("f1"), F.col("support").cast("long").alias("support"))


@query
def pairwise_cosine(spark: SparkSession, d: str) -> DataFrame:
    return similarity.pairwise_cosine(table(spark, d, "embeddings"), "label").select("label", "n", _six("mean_cosine"))


@query
def centroid_cosine(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    return similarity.centroid_cosine(vectors, similarity.centroids(vectors, "label"), "vec_id", "label").select("label", _six("mean_cosine"))


@query
def transrate(spark: SparkSession, d: str) -> DataFrame:
    return similarity.transrate(table(spark, d, "embeddings"), "label").select("transrate")


@query
def self_bleu(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "role", "text")
    return diversity.self_bleu(c, "id", "role").select("role", "n", _six("self_bleu"))


@query
def model_benchmark(spark: SparkSession, d: str) -> DataFrame:
    records = generation.flatten_tokens(fx.generated(spark, d))
    return generation.benchmark(generation.speed_and_cost(records, generation.price_table(spark)))


@query
def generator_report(spark: SparkSession, d: str) -> DataFrame:
    records = generation.valid(fx.generated(spark, d))
    bleu = diversity.self_bleu(records.withColumn("text", F.concat_ws(" ", "label", "model", (F.col("record_id") % 5).cast("string"))), "record_id", "model")
    return generation.with_diversity(records.groupBy("model").agg(F.count("*").alias("n")), bleu).select("model", "n", _six("diversity_score"))


@query
def quota(spark: SparkSession, d: str) -> DataFrame:
    return generation.progress(generation.valid(fx.generated(spark, d)))


@query
def json_flatten(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    text = F.to_json(F.array("text"))
    raw = F.when(F.col("turn") % 3 == 0, F.to_json(F.array("role", "text"))).when(F.col("turn") % 3 == 1, F.to_json(F.array(F.struct("text")))).otherwise(F.substr(text, F.lit(2), F.length(text) - 2))
    return c.select("conv_id", "turn", tx.flatten_post(raw).alias("text"))


@query
def message_links(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    user = F.when(F.col("conv_id") % 2 == 0, "channel").otherwise("")
    return c.select("conv_id", "turn", tx.message_url(user, F.concat(F.lit("-100"), F.col("conv_id").cast("string")), F.col("turn")).alias("url"))


@query
def curve_pad(spark: SparkSession, d: str) -> DataFrame:
    return fx.runs(spark, d).select("condition", "seed", F.posexplode(evaluation.pad_curve(F.col("curve"))).alias("i", "value")).select("condition", "seed", (F.col("i") + 1).alias("epoch"), "value")


@query
def early_stop(spark: SparkSession, d: str) -> DataFrame:
    return fx.runs(spark, d).select("condition", "seed", evaluation.early_stop(F.col("curve")).alias("s")).select("condition", "seed", "s.*")


@query
def epoch_stats(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.epoch_stats(fx.runs(spark, d), "condition", "curve").select("condition", "epoch", _six("mean"), _six("std"))


@query
def confidence_interval(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.confidence(fx.metrics(spark, d), ["condition", "metric"], "value").select("condition", "metric", "n", _six("mean"), _six("margin"))


@query
def ci_delta(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.confidence_of_delta(fx.metrics(spark, d), "condition", fx.BASE, "seed", ["metric"], "value").select("condition", "metric", _six("mean"), _six("margin"), "positive")


def _paired(spark: SparkSession, d: str) -> DataFrame:
    rows = evaluation.deltas(fx.metrics(spark, d), "condition", fx.BASE, "seed", ["metric"], "value")
    return evaluation.t_test(rows, ["condition", "metric"], F.col("delta"))


def _one_sample(spark: SparkSession, d: str) -> DataFrame:
    constant = F.create_map(*(F.lit(x) for pair in fx.CONSTANTS.items() for x in pair))[F.col("metric")]
    return evaluation.t_test(fx.metrics(spark, d), ["condition", "metric"], F.col("value") - constant)


@query
def paired_ttest(spark: SparkSession, d: str) -> DataFrame:
    return _paired(spark, d).select("condition", "metric", _six("mean_difference"), _six("t"), _six("p"))


@query
def one_sample_ttest(spark: SparkSession, d: str) -> DataFrame:
    return _one_sample(spark, d).select("condition", "metric", _six("mean_difference"), _six("t"), _six("p"))


@query
def holm(spark: SparkSession, d: str) -> DataFrame:
    tests = _paired(spark, d).withColumn("test", F.lit("paired")).unionByName(_one_sample(spark, d).withColumn("test", F.lit("one-sample")))
    return stats.holm(tests.withColumn("p", F.round("p", 9)), ["metric"]).select("test", "condition", "metric", _six("p"), _six("p_holm"), "significant")


@query
def cartography(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    prefix = F.when(F.col("label") < 4, "golden_").when(F.col("label") < 8, "aug_").otherwise("other_")
    rows = e.select(F.concat(prefix, F.col("vec_id").cast("string")).alias("id"), F.transform(F.slice("embedding", 1, 8), lambda v: F.round(v.cast("double"), 4)).alias("history"))
    return evaluation.cartography(rows).select("id", "origin", _six("confidence"), _six("variability"))


@query
def strat_split(spark: SparkSession, d: str) -> DataFrame:
    return sampling.split(fx.classes(spark, d), 0.2, "doc_id", 42, "actual").select("doc_id", "actual", "part")


@query
def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample(table(spark, d, "documents"), 300, "doc_id", 7).select("doc_id", "source")


@query
def weighted_choice(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", sampling.weighted_choice(generation.MODEL_WEIGHTS, 5, key).alias("model"), sampling.temperature(6, key).alias("temperature"))


@query
def prompt_gen(spark: SparkSession, d: str) -> DataFrame:
    return prompts.generate(fx.generated(spark, d).select("record_id", "label"), "record_id", "label", 42).select("record_id", "prompt")


@query
def prompt_grammar(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", prompts.ANNOUNCEMENT.column(11, F.col("event_id")).alias("prompt"))


@query
def suffix_lemmas(spark: SparkSession, d: str) -> DataFrame:
    known = fx.inflected(spark, d)
    rules = lemmas.rules(known.filter("part > 0").select("word", "lemma"))
    return lemmas.guessed(known.filter("part = 0").select("word"), rules).select("word", "lemma")


def _labelled_vectors(spark: SparkSession, d: str, labels: int) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings").filter(F.col("label") < labels)
    from pyspark.ml.functions import array_to_vector

    e = e.withColumn("features", array_to_vector(F.transform("embedding", lambda x: x.cast("double")))).withColumn("label", F.col("label").cast("double"))
    parts = sampling.split(e, 0.2, "vec_id", 42, "label")
    return parts.filter("part = 'train'").drop("part"), parts.filter("part = 'test'").drop("part")


@query
def lr_predict(spark: SparkSession, d: str) -> DataFrame:
    train, test = _labelled_vectors(spark, d, 10)
    return ml.logistic(train, "label").transform(test).select("vec_id", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"))


@query
def svm_pad(spark: SparkSession, d: str) -> DataFrame:
    return linear.pad_leaderboard(table(spark, d, "embeddings"), "label", "vec_id")


@query
def network_runs(spark: SparkSession, d: str) -> DataFrame:
    told = network.learning_curves(table(spark, d, "embeddings"), "vec_id", "label", fx.SHARES, fx.SEEDS, epochs=fx.EPOCHS)
    return told.select("condition", "seed", "epoch", *(_six(c) for c in ("train_loss", "val_macro_f1")), "best")


@query
def landmark_map(spark: SparkSession, d: str) -> DataFrame:
    return maps.mapped(table(spark, d, "embeddings"), "vec_id").select("vec_id", "label", "x", "y")


@query
def pca(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return ml.pca(table(spark, d, "embeddings"), "embedding").select("vec_id", vector_to_array("pca").alias("pca"))


@query
def tfidf_logistic(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text").join(fx.classes(spark, d).select("doc_id", "actual"), "doc_id")
    dedup.ensure_checkpoints(spark)
    # split once: all that follows reads it several times
    parts = sampling.split(docs.withColumn("label", (F.col("actual") == "junk").cast("double")), 0.2, "doc_id", 42, "actual").checkpoint()
    train, test = (parts.filter(F.col("part") == p).drop("part") for p in ("train", "test"))
    terms = features.chosen(features.frequencies(train, "doc_id"), train.count(), min_df=3, max_df=0.8, max_features=15000)
    terms = terms.checkpoint()
    fitted = ml.logistic(ml.vectors(train, terms, "doc_id").select("label", "features").checkpoint(), "label")
    return fitted.transform(ml.vectors(test, terms, "doc_id")).select("doc_id", "label", "prediction")


@query
def best_run(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.best_run(fx.metrics(spark, d), ["condition", "metric"], "value", "seed")


@query
def axis_bound(spark: SparkSession, d: str) -> DataFrame:
    bars = evaluation.confidence_of_delta(fx.metrics(spark, d), "condition", fx.BASE, "seed", ["metric"], "value").withColumn("constant_delta", F.lit(-0.0581))
    return evaluation.axis_bound(bars).select(_six("bound"))


@query
def map_anchors(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.anchors(QUERIES["cartography"](spark, d)).select(_six("easy_x"), _six("hard_x"))


@query
def macro_centroid_cosine(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    return similarity.macro(similarity.centroid_cosine(vectors, similarity.centroids(vectors, "label"), "vec_id", "label")).select(_six("macro_mean_cosine"))


def _losses(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("u", sampling.uniform(42, F.col("doc_id")))
    return masked.losses(masked.fit(docs.filter("u >= 0.2")), docs.filter("u < 0.2"), "doc_id", most=None)


@query
def token_losses(spark: SparkSession, d: str) -> DataFrame:
    return _losses(spark, d).select("doc_id", _six("loss"), "n_tokens")


@query
def pseudo_perplexity(spark: SparkSession, d: str) -> DataFrame:
    scored = _losses(spark, d).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return diversity.pseudo_perplexity(scored, "source").select("source", F.round("pppl", 4).alias("pppl"))


@query
def softmax_predict(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("logits", F.transform(F.slice("embedding", 1, 3), lambda x: F.round(x.cast("double"), 4)))
    label, p = ml.predicted(F.col("logits"), fx.LABELS)
    loss = ml.cross_entropy(F.col("logits"), (F.col("vec_id") % 3).cast("int"), F.array(F.lit(1.0), F.lit(2.0), F.lit(0.5)))
    return e.select("vec_id", label.alias("label"), p.alias("p"), loss.alias("loss")).select("vec_id", "label", _six("p"), _six("loss"))


@query
def warmup_schedule(spark: SparkSession, d: str) -> DataFrame:
    steps = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("step")).distinct()
    total = steps.agg(F.max("step")).first()[0] + 1
    return steps.select("step", F.round(evaluation.warmup_rate(F.col("step"), total, 2e-5) * 1e6, 6).alias("rate"))


@query
def experiment_sizes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return evaluation.metadata(docs, table(spark, d, "benchmark"), docs.filter("lang = 'es'"), True, True)


@query
def crawl_targets(spark: SparkSession, d: str) -> DataFrame:
    from lexarbor.sources import readers

    return readers.linked_targets(table(spark, d, "pages"), "url", "page_id").select("name", "entity")


@query
def fill_quotas(spark: SparkSession, d: str) -> DataFrame:
    from lexarbor.streaming import ingest

    records = generation.valid(fx.generated(spark, d))
    have = records.filter("record_id % 2 = 0").select("record_id", "label")
    return ingest.take_open(records.select("record_id", "label"), have, "record_id", {"junk": 2000, "single": 1700, "listing": 10})
