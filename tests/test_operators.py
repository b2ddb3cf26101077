import hashlib
import json
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexarbor import schemas
from lexarbor.functions import text as tx
from lexarbor.operators import corpus, dedup, diversity, embedding, features, generation, leakage, ml, sampling, similarity
from lexarbor.sources import readers, sinks
from lexarbor.streaming import ingest


def test_survivors_are_those_of_a_sequential_pass(spark):
    rng = random.Random(1)
    rows = [(d, b, str(rng.randrange(12))) for d in range(80) for b in range(2)]
    rows += [(100, 0, "p"), (101, 0, "p"), (101, 1, "q"), (102, 1, "q")]  # a chain: the ends stay
    kept, seen = [], set()
    for d in sorted({r[0] for r in rows}):
        own = {(b, x) for e, b, x in rows if e == d}
        if not own & seen:
            kept.append(d)
            seen |= own
    got = dedup.survivors(spark.createDataFrame(rows, "d long, band int, bucket string"), "d")
    assert sorted(r.d for r in got.collect()) == kept and 102 in kept


def test_url_and_text_leaks(spark):
    rows = spark.createDataFrame([(1, "A  b", "u1"), (2, "c", None), (3, "d", "u3"), (3, "d", "u3"), (4, "e", "")], "id long, text string, url string")
    gold = spark.createDataFrame([("a B", "u9"), ("x", None)], "text string, url string")
    assert sorted(r.id for r in leakage.without_texts(rows, gold).collect()) == [2, 3, 3, 4]
    assert leakage.without_urls(rows, gold).count() == 5
    blank = gold.withColumn("url", F.lit(""))
    assert sorted(r.id for r in leakage.without_urls(rows, blank).collect()) == [1, 3, 3]
    assert leakage.without_urls(rows, blank, ignore_blank=True).count() == 5


def test_fuzzy_leaks(spark):
    rows = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dogs"), (2, "something else entirely different"), (3, "")], "id long, text string")
    gold = spark.createDataFrame([(9, "the quick brown fox jumps over the lazy dog")], "item long, text string")
    got = {r.id: r.max_cosine for r in leakage.similarity(rows, gold, "id", "item").collect()}
    assert got[1] > 0.9 > got[2] and got[3] == 0
    assert sorted(r.id for r in leakage.decontaminate(rows, gold, "id", "item").collect()) == [2, 3]


def test_self_bleu_is_brute_force(spark):
    rng = random.Random(3)
    texts = [(i, "g", " ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 9)))) for i in range(14)] + [(99, "one", "a b")]

    def bleu(h, refs):
        if not h:
            return 0.0
        logs, first = 0.0, 0
        for n in range(1, 5):
            grams = lambda w, n=n: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
            own, most = grams(h), Counter()
            for r in refs:
                most |= grams(r)
            hit = sum(min(c, most[g]) for g, c in own.items())
            first = hit if n == 1 else first
            logs += np.log((hit or 0.1) / max(1, sum(own.values())))
        ref = min((abs(len(r) - len(h)), len(r)) for r in refs)[1]
        return 0.0 if not first else (1.0 if len(h) > ref else np.exp(1 - ref / len(h))) * np.exp(logs / 4)

    words = [t.split() for _, g, t in texts if g == "g"]
    want = np.mean([bleu(w, words[:i] + words[i + 1 :]) for i, w in enumerate(words)])
    got = {r.g: r.self_bleu for r in diversity.self_bleu(spark.createDataFrame(texts, "id long, g string, text string"), "id", "g").collect()}
    assert abs(got["g"] - want) < 1e-9 and got["one"] is None


def test_cosine_and_transrate(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(60, 5)) + 0.5, np.repeat([0, 1, 2], [30, 29, 1])
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y, strict=True))], "id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {r.label: r.mean_cosine for r in similarity.pairwise_cosine(df, "label").collect()}
    s = u[y == 0] @ u[y == 0].T
    assert abs(got[0] - s[np.triu_indices(30, 1)].mean()) < 1e-12 and got[2] is None
    assert tuple(similarity.transrate(df.limit(0), "label").first()) == (0, 0.0) and tuple(similarity.transrate(df.filter("label = 2"), "label").first()) == (1, 0.0)
    logdet = lambda z: 0.5 * np.linalg.slogdet(np.cov(z.T) + 1e-4 * np.eye(5))[1]
    assert abs(similarity.transrate(df, "label").first().transrate - (logdet(x) - 30 / 60 * logdet(x[y == 0]) - 29 / 60 * logdet(x[y == 1]))) < 1e-9


def test_generation_defaults(spark):
    rows = [("a", "m", 0.0, {"prompt_tokens": 1_000_000, "completion_tokens": None, "total_tokens": 1}, "t"), ("b", "m", None, None, None), ("x", None, 1.0, None, "t")]
    df = spark.createDataFrame(rows, "label string, model string, latency_sec double, tokens struct<prompt_tokens:long,completion_tokens:long,total_tokens:long>, text string")
    prices = spark.createDataFrame([("m", 2.0, 3.0)], "model string, price_in double, price_out double")
    got = {r.label: r for r in generation.speed_and_cost(generation.flatten_tokens(df), prices).collect()}
    assert (got["a"].tps, got["a"].cost_usd) == (0.0, 2.0) and got["b"].tps is None and got["x"].cost_usd == 0.0
    assert {r.label: r.remaining for r in generation.progress(df, {"a": 3, "b": 1}).collect()} == {"a": 2, "b": 0}


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    a, b = ({r.id for r in sampling.sample(d, 50, "id", 1).collect()} for d in (df.repartition(1), df.repartition(16)))
    assert a == b and len(a) == 50 and sampling.sample(df, 5000, "id", 1).count() == 1000
    parts = {(r.g, r.part): r["count"] for r in sampling.split(df, 0.2, "id", 1, "g").groupBy("g", "part").count().collect()}
    assert parts[(0, "test")] == 67 and parts[(1, "test")] == 67 and parts[(2, "train")] == 266
    pool = spark.range(10)
    groups = spark.createDataFrame([("m", i) for i in range(4)] + [("n", 1)], "model string, i int")
    assert {r.model: r["count"] for r in sampling.balanced(pool, groups, "model", "id", 3).groupBy("model").count().collect()} == {"m": 4, "n": 1}
    with pytest.raises(ValueError):
        sampling.balanced(pool.limit(2), groups, "model", "id", 3)


def test_readers_and_sinks(spark, tmp_path):
    posts = [{"id": 1, "url": "u", "date": "d", "text": [" a ", {"text": "b"}]}, {"id": 2, "text": ""}, {"id": 3, "text": "c d"}]
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "deep" / "chan.json").write_text(json.dumps(posts))
    (tmp_path / "in" / "bad.json").write_text("[{")
    good, bad = readers.channel_files(spark, str(tmp_path / "in"))
    assert sorted((r.channel, r.url, r.text, r.text_length) for r in good.collect()) == [("chan", "", "c d", 2), ("chan", "u", "a b", 2)]
    assert [r.channel for r in bad.collect()] == ["bad"]
    (tmp_path / "x.jsonl").write_text('{"text":"é","label":"junk"}\n\n{oops\n')
    rows, rejects = readers.jsonl(spark, str(tmp_path / "x.jsonl"), schemas.LABELLED)
    assert [(r.text, r.label) for r in rows.collect()] == [("é", "junk")] and [r.value for r in rejects.collect()] == ["{oops"]
    df = spark.createDataFrame([('q"uote,\nline', 1)], "a string, b long")
    sinks.csv(df, str(tmp_path / "csv"))
    assert readers.csv(spark, str(tmp_path / "csv"), df.schema).collect() == df.collect()
    sinks.json_array(df, str(tmp_path / "array"))
    assert readers.json_array(spark, str(tmp_path / "array"), df.schema).collect() == df.collect()
    sinks.append(df, str(tmp_path / "log"))
    sinks.append(df, str(tmp_path / "log"))
    assert spark.read.schema(df.schema).json(str(tmp_path / "log")).count() == 2
    names = readers.targets(spark, ["https://t.me/x", "https://t.me/y", "https://t.me/x"], [{"name": "z", "entity": "e", "topic_id": 6}])
    assert sorted((r.name, r.topic_id) for r in names.collect()) == [("x", None), ("y", None), ("z", 6)]
    report = {"junk": {"precision": 0.5, "f1-score": 0.25}, "accuracy": 0.75}
    runs = [{"seed": s, "golden_classification_report": report, "golden_confusion_matrix": [[1]], "learning_curve": [{"epoch": 1, "val_macro_f1": 0.5}]} for s in (40, 41)]
    (tmp_path / "run.json").write_text(json.dumps({"metadata": {"aug_enabled": True}, "runs": runs}, indent=1))
    told = readers.experiment(spark, str(tmp_path / "run.json"))
    r = F.col("golden_classification_report")
    assert [tuple(x) for x in told.select("seed", readers.report_value(r, "junk", "f1-score"), readers.report_value(r, "accuracy"), "metadata.aug_enabled").orderBy("seed").collect()] == [(40, 0.25, 0.75, True), (41, 0.25, 0.75, True)]
    (tmp_path / "map.json").write_text(json.dumps({"golden_1": {"history": [0.5]}}))
    assert [tuple(r) for r in readers.cartography(spark, str(tmp_path / "map.json")).collect()] == [("golden_1", [0.5])]


def test_stream_fills_quotas_once(spark, tmp_path):
    schema = "id long, label string, text string"
    source = tmp_path / "in"
    for i in range(3):
        rows = [(i * 10 + j, "junk" if j % 2 else "single", None if j == 4 else f"t{j}") for j in range(6)] + [(0, "single", "again")]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    paths = [str(tmp_path / p) for p in ("out", "bad", "check")]
    ingest.fill_quotas(stream, *paths, "id", {"junk": 5, "single": 4}).awaitTermination(120)
    got = spark.read.option("recursiveFileLookup", True).parquet(paths[0])
    assert {r.label: r["count"] for r in got.groupBy("label").count().collect()} == {"junk": 5, "single": 4}
    assert got.select("id").distinct().count() == 9
    assert spark.read.option("recursiveFileLookup", True).parquet(paths[1]).count() == 3


def test_retries_are_bounded(spark):
    rows = spark.range(6).withColumnRenamed("id", "k")
    made, rejects = ingest.with_retries(rows, lambda r, n: r.withColumn("text", F.when(F.col("k") <= n, "ok")), "k", 3)
    assert sorted(r.k for r in made.collect()) == [0, 1, 2] and rejects.count() == 3


def test_draws_take_exactly_the_least_hashes(spark):
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else f"g{i % 3}") for i in range(400)] + [(7, "g1")] * 3 + [(None, "g0")], "id long, g string")
    want = spark.createDataFrame([("g0", 1000), ("g1", 20), (None, 1)], "g string, _k long")
    got = sampling.least(rows, ["g"], want, "id", 9)
    assert got.count() == 404 and {(r.g, r.n) for r in got.filter("_least").groupBy("g").agg(F.count("*").alias("n")).collect()} == {("g0", rows.filter("g = 'g0'").count()), ("g1", 20), (None, 1)}
    ranked = sorted((hashlib.md5(f"9:{r.id}".encode()).hexdigest(), r.id) for r in rows.filter("g = 'g1'").collect())
    assert sorted(r.id for r in got.filter("_least and g = 'g1'").collect()) == sorted(i for _, i in ranked[:20])
    plain = sampling.split(rows, 0.25, "id", 1)
    assert plain.filter("part = 'test'").count() == 101 and sampling.split(rows.limit(0), 0.25, "id", 1, "g").isEmpty()
    assert sampling.sample_per_group(rows, "g", 2, "id", 1).count() == 8


def test_signatures_are_brute_force(spark):
    table = np.array(dedup.coefficients(8), np.int64)
    rng = random.Random(5)
    lists = [[f"w{rng.randrange(50)}" for _ in range(n)] for n in (3, 0, 7, 1, 200_000, 0, 5)]
    code = lambda w: int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "big") % dedup.PRIME
    want = [[min(((int(a) * code(w) + int(b)) % dedup.PRIME for w in set(ws)), default=dedup.PRIME) for a, b in table] for ws in lists]
    column = pa.array([["dropped"], *lists])[1:]  # a sliced array
    assert dedup.signatures(column, table).tolist() == want and len(dedup.signatures(column[:0], table)) == 0


def test_prefixes_lose_no_leak(spark):
    rng = random.Random(2)
    base = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma"]) + str(rng.randrange(9)) for _ in range(12)) for _ in range(12)]
    rows = [(i, " ".join(w for w in base[i % 12].split() if rng.random() > 0.15 * (i % 4))) for i in range(60)] + [(60, None), (61, "")]
    df, gold = spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame(list(enumerate(base)), "item long, text string")
    for threshold in (0.7, 0.9):
        want = {r.id for r in leakage.similarity(df, gold, "id", "item").filter(F.round("max_cosine", 9) >= threshold).collect()}
        got = [r.id for r in leakage.leaks(df, gold, "id", "item", threshold).collect()]
        assert 0 < len(want) < 60 and sorted(got) == sorted(want)


def test_newest_posts_and_overview(spark):
    rows = spark.createDataFrame([("a", i % 7, i, "x y") for i in range(300)] + [("b", None, 1, None), ("b", 3, 2, "z")], "c string, t long, k long, text string")
    got = [(r.c, r.t, r.k) for r in corpus.newest(rows, "c", "t", "k", 2).collect()]
    assert got == [("a", 6, 293 - 7 + 0), ("a", 6, 293), ("b", None, 1), ("b", 3, 2)] and corpus.newest(rows, "c", "t", "k").count() == 302
    assert tuple(corpus.overview(rows, "c").first()) == (302, 2, round((600 + 1) / 302, 6))


def test_lemmas_from_a_table(spark):
    docs = spark.createDataFrame([(1, ["cats", "sat", "cats", "x"], "e"), (2, [], "e"), (3, None, None), (4, ["X", None, "ran"], "e")], "id long, words array<string>, lemma string")
    table = spark.createDataFrame([("cats", "cat"), ("ran", "run"), ("ran", "ran2"), (None, "y"), ("X", None)], "word string, lemma string")
    want = {1: ["cat", "sat", "cat", "x"], 2: [], 3: [], 4: ["X", "ran2"]}  # the least of two
    for rows in (100, 2):  # broadcast, and joined by word and salt
        got = corpus.lemmatised(docs, "words", table, rows)
        assert {r.id: [w for w in r.lemmas if w] for r in got.collect()} == want and got.columns == ["id", "words", "lemma", "lemmas"]
    assert {r.id: r.lemmas for r in corpus.lemmatised(docs.filter("id = 1"), "words", table.limit(0)).collect()} == {1: ["cats", "sat", "cats", "x"]}
    # rows that share an id keep their own words, and rows that share words have lemmas of their own
    twice = spark.createDataFrame([(1, ["los", "casa"]), (1, ["and", "the"]), (None, ["and", "the"]), (None, ["the", None]), (None, [None, "the"])], "id long, words array<string>")
    assert sorted(str(r.lemmas) for r in corpus.lemmatised(twice, "words", table).collect()) == sorted(str(w) for w in (["los", "casa"], ["and", "the"], ["and", "the"], ["the", None], [None, "the"]))
    cleaned = docs.select("id", F.lit("Cats sat").alias("clean_text"))
    assert [r.score for r in corpus.relevant_by_table(cleaned, ["cat", "sat"], table, 2).collect()] == [2] * 4


def test_emoji_and_truncation(spark):
    names = {"\U0001f468": ":man:", "\U0001f468‍\U0001f4bb": ":coder:", "*": ":star:"}
    df = spark.createDataFrame([("\U0001f468‍\U0001f4bb a\U0001f468\U0001f468*",), ("plain",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(tx.demojize(F.col("t"), names)).collect()] == [":coder: a:man::man::star:", "plain", "", None]
    assert [r[0] for r in df.select(tx.demojize(F.col("t"))).collect()] == [r.t for r in df.collect()]
    cut = spark.createDataFrame([(" a  b\nc d ",), ("a",), ("",)], "t string").select(tx.truncated(F.col("t"), 3))
    assert [r[0] for r in cut.collect()] == ["a b c", "a", ""]


def test_checkpoint_resumes(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"text":"a","label":"junk"}\n{"text":"b","label":"junk"}\n{"label":"junk"}\n{"text":"c","label":"other"}\n{broken\n')
    records, rejects, progress = ingest.resume(spark, str(tmp_path / "c.jsonl"), schemas.LABELLED, {"junk": 3, "single": 1})
    assert sorted(r.text for r in records.collect()) == ["a", "b"] and [r.value for r in rejects.collect()] == ["{broken"]
    assert {r.label: (r.have, r.remaining) for r in progress.collect()} == {"junk": (2, 1), "single": (0, 1)}
    (tmp_path / "none.jsonl").write_text("")
    assert {r.remaining for r in ingest.resume(spark, str(tmp_path / "none.jsonl"), schemas.LABELLED, {"junk": 3})[2].collect()} == {3}


def test_embedder_and_tokenizer_see_bounded_batches(spark):
    def load():
        def model(texts):
            assert 0 < len(texts) <= 16
            return [[float(len(t)), float(len(texts) <= 16)] for t in texts]

        return model

    rows = spark.range(100).withColumn("text", F.when(F.col("id") != 7, F.concat(F.lit("a b "), F.repeat(F.lit("c "), F.col("id").cast("int")))))
    got = {r.id: r.embedding for r in embedding.embed(rows, load, max_words=5).collect()}
    assert len(got) == 100 and got[7] == [0.0, 1.0] and got[0] == [3.0, 1.0] and got[99] == [9.0, 1.0]
    assert embedding.embed(rows.limit(0), load).count() == 0
    path = "/opt/tokenizers/byte_bpe_50k.json"
    tokenizers = pytest.importorskip("tokenizers")
    try:
        plain = tokenizers.Tokenizer.from_file(path)
    except Exception:
        pytest.skip("no tokenizer file here")
    some = rows.filter("id < 9")
    for limit in (None, 4):
        for r in embedding.tokenise(some, embedding.tokenizer_file(path), limit=limit).collect():
            assert r.ids == plain.encode(r.text or "", add_special_tokens=False).ids[:limit]


def test_display_order_and_rounding(spark):
    made = spark.createDataFrame([("a", None), ("b", 0.2), ("c", 0.7)], "model string, diversity_score double")
    for c in generation.SHOWN[1:-1]:
        made = made.withColumn(c, F.lit(1))
    shown = generation.displayed(made.withColumn("avg_temperature", F.lit(2)))
    assert [r.model for r in shown.collect()] == ["c", "b", "a"] and shown.columns == generation.SHOWN
    assert [r.latency_sec for r in generation.captured(spark.createDataFrame([(1.23456,), (None,)], "latency_sec double")).collect()] == [1.23, None]


def test_text_classifier_end_to_end(spark):
    docs = spark.createDataFrame([(i, ("red apple pie" if i % 2 else "blue stone wall") + f" w{i % 5}", float(i % 2)) for i in range(40)] + [(99, None, 0.0)], "id long, text string, label double")
    terms = features.fit(features.term_counts(docs, "id"), 41, min_df=3)
    made = ml.vectors(docs, terms, "id")
    names = sorted(r.term for r in terms.collect())
    weights = {}
    for r in features.tfidf(features.term_counts(docs, "id"), terms, "id", True).collect():
        weights.setdefault(r.id, {})[names.index(r.term)] = r.w
    for r in made.collect():
        assert r.features.size == len(names) and dict(zip(r.features.indices.tolist(), r.features.values.tolist())) == pytest.approx(weights.get(r.id, {}))
    model = ml.logistic(made, "label")
    assert all(r.prediction == r.label for r in model.transform(made).filter("id <> 99").collect())
    top = ml.top_features(ml.svm(made, "label"), terms, 3)
    assert {r.term for r in top.collect()} <= {n for n in names if {"red", "apple", "pie"} & set(n.split())}
    told = ml.grid(docs.filter("id < 30"), docs.filter("id between 30 and 39"), "id", "label", [{"min_df": 3, "high": 2}, {"max_features": 1, "balanced": False}], 50).collect()
    assert [(r.setting, r.macro_f1, r.accuracy) for r in told][0] == (0, 1.0, 1.0) and len(told) == 2 and len(ml.SETTINGS) == 13
    fused = ml.fused(made.withColumn("more", F.col("features")), ["features", "more"], "label")
    assert fused.transform(made.withColumn("more", F.col("features"))).filter("id <> 99 and prediction <> label").count() == 0


def test_pca_is_the_singular_decomposition(spark):
    x = np.random.default_rng(3).normal(size=(30, 6)) * [5, 3, 2, 1, 0.5, 0.1]
    got = ml.pca(spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, e array<double>"), "e", 2)
    mine = np.array([r.pca.toArray() for r in got.orderBy("id").collect()])
    axes = np.linalg.svd(x - x.mean(0))[2][:2]
    assert np.allclose(np.abs(mine), np.abs(x @ axes.T), atol=1e-8)


def test_small_sources_sinks_and_streams(spark, tmp_path):
    (tmp_path / "t.txt").write_text(" a \n\n\tb c\n")
    assert sorted(r.text for r in readers.text_lines(spark, str(tmp_path / "t.txt")).collect()) == ["a", "b c"]
    rows = spark.createDataFrame([("junk", "é"), ("other", "x"), (None, "y")], "label string, text string")
    assert [r.text for r in readers.by_class(rows).collect()] == ["é"]
    sinks.jsonl(rows, str(tmp_path / "j"))
    assert sorted(r.text for r in spark.read.schema(rows.schema).json(str(tmp_path / "j")).collect()) == ["x", "y", "é"]
    assert any("é" in p.read_text("utf-8") for p in (tmp_path / "j").glob("part-*"))
    both = corpus.union(rows, rows.limit(1).withColumn("more", F.lit(1)), names=["a", "b"])
    assert {r.dataset: r["count"] for r in both.groupBy("dataset").count().collect()} == {"a": 3, "b": 1}
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "1.json").write_text('{"url":"u","text":" a "}\n{"url":"u","text":"a"}\n{"url":"v","text":" "}\n')
    schema = spark.createDataFrame([], "url string, text string").schema
    q = ingest.posts(spark, str(tmp_path / "s"), schema).writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "k")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.url, r.text) for r in spark.read.parquet(str(tmp_path / "o")).collect()] == [("u", "a")]
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "a")], "t string, kind string").withColumn("t", F.to_timestamp("t"))
    assert sorted(r.n for r in ingest.windowed_counts(events, "t", "kind").collect()) == [1, 2]
    made = ingest.template_generator(5)(spark.range(3).withColumn("p", F.lit("Hi")), "id", "p")
    again = ingest.template_generator(5)(spark.range(3).withColumn("p", F.lit("Hi")), "id", "p")
    assert made.collect() == again.collect() and all(r.text.startswith("Hi ") and r.text_length_chars == len(r.text) for r in made.collect())
