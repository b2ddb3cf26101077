"""Classifiers on text features, and their arithmetic as expressions."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexarbor.operators import dedup, evaluation, features


def _numbered(terms: DataFrame) -> DataFrame:
    """Terms numbered from 0 in their order; a window over the fitted vocabulary, which max_features bounds."""
    return terms.withColumn("i", (F.row_number().over(W.orderBy("term")) - 1).cast("long"))


def vectors(docs: DataFrame, terms: DataFrame, key: str, low: int = 1, high: int = 2, sublinear: bool = True, counts: DataFrame | None = None) -> DataFrame:
    """docs with a sparse TF-IDF column `features`, of as many terms as were fitted (max_features bounds them). counts: the documents' term counts, if they are there.

    The vectors are made in the JVM: a struct of the vector type's own fields, read as that type through JSON.
    """
    from pyspark.ml.linalg import VectorUDT

    numbered = _numbered(terms.select("term", "idf"))
    size = terms.count()
    if counts is None and size <= features.MOST_TERMS and features.alone(docs, key)[1] is None:
        packed = features.packed(docs, numbered, key, low, high, sublinear)
    else:
        weights = features.tfidf(features.term_counts(docs, key, low, high) if counts is None else counts, numbered, key, sublinear).join(numbered.select("term", "i"), "term")
        packed = weights.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "w"))).alias("t"))
    held = F.coalesce("t", F.array().cast("array<struct<i:long,w:double>>"))
    fields = F.struct(F.lit(0).alias("type"), F.lit(size).alias("size"), F.transform(held, lambda x: x["i"]).alias("indices"), F.transform(held, lambda x: x["w"]).alias("values"))
    read = F.from_json(F.to_json(F.struct(fields.alias("v"))), T.StructType([T.StructField("v", VectorUDT())]))
    return docs.join(packed, key, "left").withColumn("features", read["v"]).drop("t")


def logistic(train: DataFrame, label: str, c: float = 5.0, rounds: int = 1000, balanced: bool = True, features: str = "features"):
    """Multinomial logistic regression, classes balanced if asked for, with the ridge that C stands for."""
    weights = evaluation.class_weights(train, label).select(label, F.col("weight") if balanced else F.lit(1.0).alias("weight"))
    weighted = train.join(F.broadcast(weights), label)  # a row a class
    total = weighted.agg(F.sum("weight")).first()[0]
    return LogisticRegression(family="multinomial", featuresCol=features, elasticNetParam=0.0, standardization=False, weightCol="weight", labelCol=label, regParam=1 / (c * total), maxIter=rounds).fit(weighted)


def svm(train: DataFrame, label: str, rounds: int = 100):
    """Linear SVM (hinge loss)."""
    return LinearSVC(labelCol=label, regParam=0.01, maxIter=rounds).fit(train)


def top_features(model, terms: DataFrame, n: int = 15) -> DataFrame:
    """(term, weight): the n terms of largest weight of a linear two-class model."""
    spark = terms.sparkSession
    weights = spark.createDataFrame([(i, float(w)) for i, w in enumerate(model.coefficients.toArray())], "i long, weight double")
    return _numbered(terms.select("term")).join(weights, "i").orderBy(F.desc("weight"), "term").limit(n).select("term", "weight")


def pca(rows: DataFrame, column: str, k: int = 50) -> DataFrame:
    """rows with `pca`, at most k coordinates and no more than there are rows or dimensions; signs are arbitrary."""
    first = rows.select(F.size(column)).first()
    k = min(k, rows.limit(k).count(), first[0] if first else k)
    with_vector = rows.withColumn("_v", array_to_vector(F.transform(column, lambda x: x.cast("double"))))
    return PCA(k=k, inputCol="_v", outputCol="pca").fit(with_vector).transform(with_vector).drop("_v")


def fused(rows: DataFrame, columns: list[str], label: str, c: float = 5.0, rounds: int = 1000):
    """A logistic regression on several feature vectors side by side, classes balanced; transform() takes the same columns."""
    beside = VectorAssembler(inputCols=columns, outputCol="all")
    return PipelineModel([beside, logistic(beside.transform(rows), label, c, rounds, features="all")])


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda z: F.exp(z - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, v: a + v))


def predicted(logits: Column, labels: list[str], text: Column | None = None) -> tuple[Column, Column]:
    """(label, probability) of the largest logit, the first of equals; an empty text is `junk` with probability 0."""
    p = softmax(logits)
    at = F.array_position(logits, F.array_max(logits)).cast("int")
    label, probability = F.element_at(F.array(*(F.lit(x) for x in labels)), at), F.array_max(p)
    if text is None:
        return label, probability
    blank = text.isNull() | (text == "")
    return F.when(blank, "junk").otherwise(label), F.when(blank, 0.0).otherwise(probability)


def cross_entropy(logits: Column, label: Column, weights: Column) -> Column:
    """The weighted loss of one row: its class's weight times the negative log-probability of its class (codes from 0)."""
    return -F.element_at(weights, label + 1) * F.log(F.element_at(softmax(logits), label + 1))


def mean_pooled(tokens: Column, mask: Column) -> Column:
    """The masked mean of token vectors; the divisor is 1e-9 at least."""
    n = F.greatest(F.aggregate(mask, F.lit(0.0), lambda a, m: a + m), F.lit(1e-9))
    width = F.size(F.element_at(tokens, 1))
    total = lambda i: F.aggregate(F.zip_with(tokens, mask, lambda t, m: F.element_at(t, i) * m), F.lit(0.0), lambda a, v: a + v)
    return F.transform(F.sequence(F.lit(1), width), lambda i: total(i) / n)


#: The configurations that are compared, the most frequent terms (None: all), the longest n-gram, sublinear counts, balanced classes, C.
SETTINGS = [
    {"max_features": m, "high": high, "sublinear": sub, "balanced": bal, "c": c}
    for m, high, sub, bal, c in (
        (1500, 1, False, False, 1.0), (1500, 1, False, True, 1.0), (5000, 1, False, False, 1.0), (5000, 1, False, True, 1.0), (10000, 1, False, True, 1.0), (None, 1, False, True, 1.0), (None, 1, True, True, 1.0),
        (10000, 2, True, True, 1.0), (20000, 2, True, True, 1.0), (None, 2, True, True, 1.0), (None, 2, True, True, 0.5), (None, 2, True, True, 2.0), (None, 2, True, True, 5.0),
    )
]


def grid(train: DataFrame, test: DataFrame, key: str, label: str, settings: list[dict] | None = None, rounds: int = 1000) -> DataFrame:
    """(setting, macro_f1, accuracy), best first: the logistic regression for each of the settings (numbers in their list).

    The n-grams of all texts are counted once, up to the longest asked for, and so are their document frequencies; a setting is a filter over these tables.
    """
    settings = SETTINGS if settings is None else settings
    dedup.ensure_checkpoints(train.sparkSession)
    longest = max(s.get("high", 1) for s in settings)
    count = lambda docs: features.term_counts(docs, key, 1, longest).withColumn("size", F.size(F.split("term", " "))).checkpoint()
    counts, others, n = count(train), count(test), train.count()
    terms = counts.groupBy("term", "size").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).checkpoint()
    told = None
    for i, s in enumerate(settings):
        some = features.chosen(terms.filter(F.col("size") <= s.get("high", 1)), n, s.get("min_df", 1), s.get("max_df", 1.0), s.get("max_features")).checkpoint()
        a, b = (vectors(docs, some, key, sublinear=s.get("sublinear", False), counts=c) for docs, c in ((train, counts), (test, others)))
        guess = logistic(a, label, s.get("c", 1.0), rounds, s.get("balanced", True)).transform(b)
        one = guess.groupBy(F.col(label).cast("string").alias("actual"), F.col("prediction").cast("string").alias("predicted")).agg(F.count("*").alias("n")).withColumn("setting", F.lit(i))
        told = one if told is None else told.unionByName(one)
    told = told.checkpoint()
    side = lambda c, name: told.groupBy("setting", F.col(c).alias("label")).agg(F.sum("n").alias(name))
    hit = told.filter("actual = predicted").groupBy("setting", F.col("actual").alias("label")).agg(F.sum("n").alias("hit"))
    each = side("actual", "support").join(side("predicted", "claimed"), ["setting", "label"], "full").join(hit, ["setting", "label"], "left").fillna(0)
    scored = each.groupBy("setting").agg(F.avg(2 * F.col("hit") / (F.col("support") + F.col("claimed"))).alias("macro_f1"), (F.sum("hit") / F.sum("support")).alias("accuracy"))
    return scored.orderBy(F.desc("macro_f1"), "setting")
