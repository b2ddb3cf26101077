"""What grows with a table: steps that were shuffled or broadcast by word or n-gram, and their results on odd inputs."""

import random

from pyspark.sql import functions as F

from lexarbor.operators import corpus, diversity, features, leakage, masked, ml


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def words(rng, n, of="abcdefgh"):
    return " ".join("".join(rng.choice(of) for _ in range(rng.randrange(1, 7))) for _ in range(n))


def leaky(spark, rng):
    gold = [(i, words(rng, 40)) for i in range(30)] + [(30, None), (7, "twice told")]
    rows = [(100 + i, words(rng, rng.randrange(0, 60))) for i in range(60)] + [(200 + i, f"{gold[i][1]} {words(rng, i)}") for i in range(12)]
    rows += [(300, None), (301, ""), (302, " \t"), (200, "told again"), (None, gold[0][1]), (303, "Éa ß\U0001f600x")]
    return spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame(gold, "item long, text string")


def test_cosines_are_found_without_a_join_of_n_grams(spark, monkeypatch):
    rows, gold = leaky(spark, random.Random(4))
    want = sorted((r.id or -1, round(r.max_cosine, 9)) for r in leakage._joined_similarity(rows, gold, "id", "item").collect())
    assert max(x for _, x in want) > 0.9
    for dense, block in ((2048, 10**6), (5, 300)):
        monkeypatch.setattr(leakage, "DENSE", dense)
        monkeypatch.setattr(leakage, "BLOCK", block)
        got = leakage.similarity(rows, gold, "id", "item")
        assert sorted((r.id or -1, round(r.max_cosine, 9)) for r in got.collect()) == want
        assert "gram" not in plan(got)


def test_leaks_are_found_without_a_join_of_n_grams(spark, monkeypatch):
    rows, gold = leaky(spark, random.Random(5))
    cosines = {r.id: r.max_cosine for r in leakage._joined_similarity(rows, gold, "id", "item").collect() if r.id is not None}
    for threshold in (0.5, 0.8, 0.9):
        want = sorted(i for i, c in cosines.items() if round(c, 9) >= threshold)
        assert want
        for block in (10**6, 300):
            monkeypatch.setattr(leakage, "BLOCK", block)
            got = leakage.leaks(rows, gold, "id", "item", threshold)
            assert sorted(r.id for r in got.collect()) == want and "gram" not in plan(got)
    monkeypatch.setattr(leakage, "MOST_GRAMS", 10)
    assert sorted(r.id for r in leakage.leaks(rows, gold, "id", "item", 0.9).collect()) == want


def test_self_bleu_broadcasts_no_n_grams(spark):
    texts = spark.createDataFrame([(i, "g", f"a b c {i}") for i in range(9)], "id long, g string, text string")
    told = diversity.self_bleu(texts, "id", "g")
    assert told.count() == 1 and plan(told).count("SortMergeJoin") >= 2
    assert told._jdf.queryExecution().optimizedPlan().toString().count("strategy=merge") >= 2


def test_words_around_are_hashed_and_listed_once(spark):
    rows = spark.createDataFrame([(1, "b a b a b"), (2, ""), (3, None), (4, "A")], "id long, text string")
    told = masked.between(rows, ["id"])
    assert [f.dataType.simpleString() for f in told.schema] == ["bigint"] * 4 and told.count() == 6
    assert told._jdf.queryExecution().optimizedPlan().toString().count("arrays_zip") == 1


def test_terms_are_counted_by_the_task_that_reads_them(spark, monkeypatch):
    monkeypatch.setattr(features, "PIECE_WORDS", 50)
    rng = random.Random(6)
    rows = [(i, words(rng, rng.randrange(0, 40), "abc")) for i in range(40)] + [(3, "twice told aa"), (None, "aa bb"), (None, "bb aa bb"), (50, None), (51, "x")]
    docs = spark.createDataFrame(rows, "id long, text string")
    told = lambda df: sorted((str(r.id), r.term, round(r.w, 9)) for r in df.collect())
    for low, high in ((1, 1), (1, 2), (2, 3)):
        counts = features.term_counts(docs, "id", low, high)
        terms = features.fit(counts, len(rows), min_df=2)
        got = features.chosen(features.frequencies(docs, "id", low, high), len(rows), min_df=2)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, terms.collect()))
        want = told(features.tfidf(counts, terms, "id", sublinear=True))
        assert want and told(features.weighted(docs, terms, "id", low, high, sublinear=True)) == want
        assert told(features.weighted(docs, terms, "id", low, high, sublinear=True, most=1)) == want
    alone = features.weighted(docs.filter("id > 3"), terms, "id", 2, 3)
    assert "Exchange" not in plan(alone)


def test_lemmas_of_a_table_without_words_of_their_own_rows(spark):
    docs = spark.createDataFrame([(1, "los gatos la casa"), (2, "und der die")], "id long, clean_text string")
    table = spark.createDataFrame([("los", "el"), ("la", "el"), ("die", "der"), (None, "x"), ("und", None)], "word string, lemma string")
    for most in (32, 0):
        corpus.MAP_ROWS = most
        told = corpus.relevant_by_table(docs, ["el", "casa", "und", "der"], table)
        assert {r.id: (r.lemmas, r.score) for r in told.collect()} == {1: (["el", "gatos", "el", "casa"], 2), 2: (["und", "der", "der"], 2)}
        assert "Exchange" not in plan(told) and "explode(_words" not in plan(told)
    corpus.MAP_ROWS = 32


def test_frequent_n_grams_are_counted_by_bucket_first(spark):
    rng = random.Random(7)
    docs = spark.createDataFrame([(words(rng, rng.randrange(0, 30), "abc"),) for _ in range(60)] + [(None,)], "text string")
    for low, high in ((1, 1), (2, 2), (1, 3)):
        plain = corpus.ngram_totals(docs, low, high).collect()
        for n in (5, 10**4):
            want = [(r.term, r.n) for r in sorted(plain, key=lambda r: (-r.n, r.term))[:n]]
            for bits in (2, 12):
                got = corpus.top_ngrams(docs, n, low, high, bits=bits).orderBy("rank").collect()
                assert [(r.term, r.n) for r in got] == want


def test_vectors_are_made_by_the_task_that_reads_a_row(spark):
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, words(rng, rng.randrange(0, 30), "abc")) for i in range(30)] + [(40, None)], "id long, text string")
    counts = features.term_counts(docs, "id")
    terms = features.fit(counts, 31, min_df=2, max_features=40).localCheckpoint()
    of = lambda df: {r.id: (r.features.size, list(r.features.indices), [round(float(x), 9) for x in r.features.values]) for r in df.collect()}
    got = ml.vectors(docs, terms, "id")
    assert of(got) == of(ml.vectors(docs, terms, "id", counts=counts)) and len(of(got)) == 31
    assert "collect_list" not in plan(got)


def test_f3_leaks_read_their_rows_once_and_folded_lengths_are_no_less_than_a_cosine(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(leakage, "MOST_GOLDEN", 3)
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    rng = random.Random(6)
    words = [f"{a}{b}" for a in ("ba", "de", "fi", "go", "ku") for b in ("lam", "nor", "pes", "rit")]
    texts = [" ".join(rng.choices(words, k=12)) for _ in range(20)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2).withColumn("text", seen("text"))
    golden = spark.createDataFrame([(i, texts[i] + " end") for i in range(0, 20, 2)], "item_id long, text string")
    found = {r.doc_id for r in leakage.leaks(rows, golden, "doc_id", "item_id").collect()}
    assert found >= set(range(0, 20, 2)) and read.value <= 40, read.value
    joined = {r.doc_id for r in leakage._joined_leaks(rows, golden, "doc_id", "item_id").collect()}
    assert found == joined
    monkeypatch.setattr(leakage, "DENSE", 3)
    monkeypatch.setattr(leakage, "FOLDED", 5)
    draw = np.random.default_rng(2)
    vectors = [(np.sort(draw.choice(60, 20, False)), draw.random(20)) for _ in range(9)]
    vectors = [(at, w / np.sqrt(w @ w)) for at, w in vectors]
    mine = leakage.Golden([a for a, _ in vectors], [w for _, w in vectors], 60)
    whole = np.zeros((9, 60))
    for i, (at, w) in enumerate(vectors):
        whole[i, at] = w
    assert (mine.folded(vectors) @ mine.lengths.T >= whole @ whole.T - 1e-5).all()


def test_f1_the_driver_holds_one_block_of_golden_texts(spark, monkeypatch):
    monkeypatch.setattr(leakage, "MOST_GOLDEN", 3)
    monkeypatch.setattr(leakage, "FETCH_CHARS", 200)
    monkeypatch.setattr(leakage, "MERGED", 4)
    rows, gold = leaky(spark, random.Random(9))
    want = {r.id for r in leakage._joined_leaks(rows, gold, "id", "item").collect()}
    cosines = sorted((r.id or -1, round(r.max_cosine, 9)) for r in leakage._joined_similarity(rows, gold, "id", "item").collect())
    send, sent, most = type(spark.sparkContext).broadcast, [], []

    def seen(self, value):
        if isinstance(value[0], list):
            most.append(sum(b._jbroadcast.isValid() for b in sent))
            sent.append(send(self, value))
            return sent[-1]
        return send(self, value)

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", seen)
    assert want and {r.id for r in leakage.leaks(rows, gold, "id", "item").collect()} == want
    assert sorted((r.id or -1, round(r.max_cosine, 9)) for r in leakage.similarity(rows, gold, "id", "item").collect()) == cosines
    assert len(sent) > 12 and max(most) == 0


def test_f3_only_n_grams_of_fitted_words_are_spelled_out(spark, monkeypatch):
    import pyarrow as pa

    lists = pa.array([["aa", "xx", "bb"], [], ["", "yy"], ["aa", "bb"]], pa.list_(pa.string()))
    assert features._masked(lists, pa.array(["", "aa", "bb"])).to_pylist() == [["aa", "\n", "bb"], [], ["", "\n"], ["aa", "bb"]]
    rng = random.Random(12)
    docs = spark.createDataFrame([(i, words(rng, rng.randrange(0, 40), "abc")) for i in range(40)] + [(50, None)], "id long, text string")
    terms = features.fit(features.term_counts(docs, "id"), 41, min_df=4, max_features=60).localCheckpoint()
    told = lambda: sorted((r.id, r.term, round(r.w, 9)) for r in features.weighted(docs, terms, "id", 1, 2, sublinear=True).collect())
    some = told()
    monkeypatch.setattr(features, "MOST_WORDED", 0)
    assert some and told() == some


def test_f3_texts_are_split_once(spark, monkeypatch):
    from lexarbor.operators import sampling
    from lexarbor.plans import queries

    held, split = [], sampling.split
    monkeypatch.setattr(sampling, "split", lambda rows, *how: held.append(split(rows.withColumn("text", seen("text")), *how)) or held[-1])
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    told = queries.QUERIES["tfidf_logistic"](spark, "/root/testdata/sf0.001")
    n = held[0].count() and spark.read.parquet("/root/testdata/sf0.001/labels.parquet").count()
    assert told.count() and read.value <= 4 * n, (read.value, n)
