import hashlib
import math
import re

from pyspark.sql import functions as F

from lexarbor.functions import stats
from lexarbor.functions import text as tx
from lexarbor.functions import vocabulary
from lexarbor.operators import corpus, evaluation, ml

TEXTS = [
    None, "", "0123456789", "0123456789a", "<b>hi</b> there all of you", "a < b and then c > d is gone", "see https://youtu.be/x and more", "bare https://youtu.be only", "https://m.youtube.com/x is a url",
    "write to a.b@c.ru please now", "on 2024-05-01 we meet again", "wide            gap of twelve", "no break\u001cspaces here", "é combining accent text", " ".join(["word"] * 400), " ".join(["word"] * 401), "ПРИВЕТ, МИР и все остальные", "  trailing and leading  words ",
]


def plain_clean(t):
    """The definition, read with the library's own table of patterns, whose classes Python spells in another way."""
    spelled = lambda p: re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", p).replace(r"\p{L}\p{N}_", r"\w")
    out = (t or "").lower()
    for pattern, to in ((tx.HTML_TAG, " "), (tx.VIDEO_URL, tx.PLACEHOLDERS["video"]), (tx.URL, tx.PLACEHOLDERS["url"]), (tx.EMAIL, tx.PLACEHOLDERS["email"]), (tx.PHONE, tx.PLACEHOLDERS["phone"])):
        out = re.sub(spelled(pattern), to, out)
    words = out.split()
    return " ".join(words[: tx.MAX_WORDS]) if len(" ".join(words)) > tx.MIN_CHARS else tx.EMPTY


def col(spark, values, f, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}").select("i", f(F.col("x")).alias("y")).orderBy("i").collect()
    return [r.y for r in rows]


def test_clean(spark):
    assert col(spark, TEXTS, tx.clean) == [plain_clean(t) for t in TEXTS]


def test_words_tokens_and_hash(spark):
    texts = [t for t in TEXTS if t]
    assert col(spark, texts, tx.word_count) == [len(t.split()) for t in texts]
    assert col(spark, ["Añb c_d é1!", ""], tx.tokens) == [["añb", "c_d", "é1"], []]
    assert col(spark, texts, tx.text_hash) == [hashlib.md5(" ".join(t.lower().split()).encode()).hexdigest() for t in texts]


def test_ngrams(spark):
    words = F.split(F.lit("a b c"), " ")
    got = spark.range(1).select(tx.word_ngrams(words, 1, 2).alias("g"), tx.word_ngrams(words, 4, 4).alias("none"), tx.char_wb_ngrams(F.lit("A bcd")).alias("c")).first()
    assert got.g == ["a", "b", "c", "a b", "b c"] and got.none == []
    assert got.c == [" a ", " bc", "bcd", "cd ", " bcd", "bcd "]


def test_flatten_and_links(spark):
    raw = ['"x"', "[]", '["a",{"text":"b"},{"type":"q"},3]', "{}", None, "broken"]
    assert col(spark, raw, tx.flatten_post) == ["x", "", "ab", "", "", ""]
    got = spark.range(1).select(tx.message_url(F.lit("me"), F.lit("-1005"), F.lit(7)).alias("a"), tx.message_url(F.lit(""), F.lit("-1005"), F.lit(7)).alias("b"), tx.last_segment(F.lit("https://t.me/x")).alias("c")).first()
    assert tuple(got) == ("https://t.me/me/7", "https://t.me/c/5/7", "x")


def test_relevance_and_lemmas(spark):
    assert len(vocabulary.KEYWORDS) == 172 and len(vocabulary.CORRECTED) == 173
    docs = spark.createDataFrame([("лекции и хакатон и хакатон",)], "clean_text string")
    dictionary = F.create_map(F.lit("лекции"), F.lit("лекци"))
    got = corpus.relevant(docs, vocabulary.lemma_set(vocabulary.KEYWORDS), 1, dictionary).first()
    assert got.score == 2
    assert corpus.relevant(docs, vocabulary.lemma_set(vocabulary.KEYWORDS), 2).count() == 0


def test_t_distribution():
    for t in (0.3, 1.0, 2.7764451):
        assert math.isclose(2 * (1 - stats.t_cdf(t, 4)), 1 - t / math.sqrt(4 + t * t) * (1 + 2 / (4 + t * t)), abs_tol=1e-12)
    assert math.isclose(stats.t_quantile(0.975, 4), 2.7764451, abs_tol=1e-6)
    assert math.isclose(stats.t_quantile(0.975, 1), 12.7062, abs_tol=1e-3) and math.isclose(stats.t_quantile(0.975, 10), 2.2281389, abs_tol=1e-6)


def test_holm_with_ties_and_nulls(spark):
    rows = spark.createDataFrame([("m", i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.03, None])], "g string, i int, p double")
    got = {r.i: r.p_holm for r in stats.holm(rows, ["g"]).collect()}
    assert [round(got[i], 6) for i in range(4)] == [0.04, 0.09, 0.09, 0.09] and got[4] is None


def test_no_deviation_gives_no_p(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 2.0), ("c", 1.0)], "g string, d double")
    got = {r.g: r.p for r in evaluation.t_test(rows, ["g"], F.col("d")).collect()}
    assert got["a"] is None and got["c"] is None and 0 < got["b"] < 1
    assert {r.g: r.margin for r in evaluation.confidence(rows, ["g"], "d").collect()}["c"] == 0


def test_report_with_labels_never_predicted_or_absent(spark):
    rows = spark.createDataFrame([("x", "x"), ("x", "y"), ("y", "x")], "actual string, predicted string")
    got = {r.label: r for r in evaluation.report(evaluation.confusion(rows, ["z", "y", "x"])).collect()}
    assert got["x"].precision == 0.5 and got["x"].recall == 0.5 and got["x"].support == 2
    assert got["z"].f1 == 0 and got["z"].support == 0 and got["y"].f1 == 0
    assert round(got["accuracy"].f1, 6) == round(1 / 3, 6) and round(got["macro avg"].f1, 6) == round(0.5 / 3, 6)


def test_curves(spark):
    curves = [[0.1, 0.3, 0.3, 0.3, 0.9], [0.5], [0.1, 0.2, 0.15, 0.3]]
    got = col(spark, curves, lambda c: evaluation.early_stop(c), "array<double>")
    assert [(r.best, r.best_epoch, r.stopped_at) for r in got] == [(0.3, 2, 4), (0.5, 1, 1), (0.3, 4, 4)]
    assert col(spark, curves, lambda c: evaluation.pad_curve(c, 6), "array<double>")[1] == [0.5] * 6


def test_cartography_and_model_arithmetic(spark):
    rows = spark.createDataFrame([("golden_1", [0.0, 1.0]), ("aug_2", [0.5] * 7), ("x", [1.0])], "id string, history array<double>")
    got = {r.id: (r.origin, r.confidence, r.variability) for r in evaluation.cartography(rows).collect()}
    assert got == {"golden_1": ("Organic", 0.5, 0.5), "aug_2": ("Synthetic", 0.5, 0.0), "x": (None, 1.0, 0.0)}
    label, p = ml.predicted(F.array(F.lit(0.0), F.lit(0.0)), ["a", "b"], F.lit(""))
    assert tuple(spark.range(1).select(label.alias("l"), p.alias("p")).first()) == ("junk", 0.0)
    loss = ml.cross_entropy(F.array(F.lit(0.0), F.lit(0.0)), F.lit(1), F.array(F.lit(1.0), F.lit(2.0)))
    assert math.isclose(spark.range(1).select(loss.alias("l")).first().l, 2 * math.log(2))
    pooled = ml.mean_pooled(F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(9.0), F.lit(9.0))), F.array(F.lit(1.0), F.lit(0.0)))
    assert spark.range(1).select(pooled.alias("x")).first().x == [1.0, 2.0]
