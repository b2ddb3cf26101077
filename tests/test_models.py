import numpy as np
import pytest
from pyspark.sql import functions as F

from lexarbor.operators import linear, maps, sampling
from lexarbor.plans import queries

SF = "/root/testdata/sf0.001"


def blobs(n=240, d=5, k=3, seed=1, apart=1.0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, k, n)
    return y, rng.normal(size=(n, d)) + apart * np.eye(k, d)[y] * 2


def frame(spark, y, x):
    return spark.createDataFrame([(i, int(a), [float(v) for v in b]) for i, (a, b) in enumerate(zip(y, x, strict=True))], "id long, g int, embedding array<double>").repartition(6)


def plain_svm(x, y, c=1.0):
    """Gradient descent on the same function, slowly and surely."""
    x = np.c_[x, np.ones(len(x))]
    w, rate = np.zeros(x.shape[1]), 1 / (1 + 2 * c * np.linalg.norm(x, 2) ** 2)
    for _ in range(20_000):
        gap = np.maximum(0, 1 - y * (x @ w))
        w = w - rate * (w - 2 * c * (y * gap) @ x)
    return w


def test_linear_models_of_all_groups_are_plain_ones(spark):
    y, x = blobs()
    sign = [[1.0 if a == g else -1.0 if (i + g) % 2 else 0.0 for g in range(3)] for i, a in enumerate(y)]
    rows = spark.createDataFrame([([float(v) for v in b], s) for b, s in zip(x, sign, strict=True)], "x array<double>, sign array<double>").repartition(7)
    got = linear.squared_hinge(rows, ["0", "1", "2"], x.shape[1])
    for g in range(3):
        on = np.array([s[g] != 0 for s in sign])
        assert np.allclose(got[g], plain_svm(x[on], np.array([s[g] for s in sign])[on]), atol=1e-5)


def test_pad_leaderboard(spark):
    y, x = blobs(600, apart=1.5)
    x[y == 2] = x[y == 1][np.arange((y == 2).sum()) % (y == 1).sum()]  # groups 1 and 2 can't be told from each other as well as 0 from both
    rows = frame(spark, y, x)
    told = {r.g: r for r in linear.pad_leaderboard(rows.unionByName(rows.limit(1).withColumn("g", F.lit(None).cast("int"))), "g", "id").collect()}
    assert set(told) == {0, 1, 2} and [r.n for r in sorted(told.values(), key=lambda r: r.g)] == [int((y == g).sum()) for g in range(3)]
    assert told[0].pad > told[1].pad >= 0 and all(abs(r.pad - 2 * (1 - 2 * min(r.error, 0.5))) < 1e-4 for r in told.values())
    # the same by hand for one group
    u = lambda s: np.array([r.u for r in rows.orderBy("id").select(sampling.uniform(s, F.col("id")).alias("u")).collect()])
    part = {r.key: r.part for r in sampling.split(rows.select(F.col("id").alias("key"), F.col("g").cast("string").alias("g")), 0.2, "key", 42, "g").collect()}
    train = np.array([part[i] == "train" for i in range(len(y))])
    n = int((y == 0).sum())
    asked = (y == 0) | (u("42:0") < n / (len(y) - n))
    sign = np.where(y == 0, 1.0, -1.0)
    w = plain_svm(x[asked & train], sign[asked & train])
    wrong = (np.c_[x, np.ones(len(x))] @ w > 0) != (sign > 0)
    assert abs(told[0].error - wrong[asked & ~train].mean()) < 1e-9
    assert linear.pad_leaderboard(rows.filter("g = 1"), "g", "id").count() == 0 and linear.pad_leaderboard(rows.limit(0), "g", "id").count() == 0
    with pytest.raises(ValueError):
        linear.pad_leaderboard(rows.withColumn("embedding", F.array_repeat(F.lit(0.5), linear.MOST + 1)), "g", "id")


def test_landmark_map_keeps_neighbours(spark):
    y, x = blobs(400, 8, 4, apart=4.0)
    rows = frame(spark, y, x).withColumn("x", F.lit("old"))
    made = maps.mapped(rows, "id", landmarks=150, rounds=400)
    told = made.orderBy("id").collect()
    assert made.columns == ["id", "g", "embedding", "x", "y"] and len(told) == 400
    at = np.array([(r.x, r.y) for r in told])
    near = np.argsort(maps.squared_distances(at, at), axis=1)[:, 1:6]
    assert (y[near] == y[:, None]).mean() > 0.97  # what belongs together lies together, landmarks or not
    again = maps.mapped(rows.repartition(2), "id", landmarks=150, rounds=400).orderBy("id").collect()
    assert np.allclose([(r.x, r.y) for r in again], at)
    assert maps.mapped(rows.limit(0), "id").count() == 0 and maps.mapped(rows.limit(1), "id").count() == 1


def test_tsne_kernel_has_the_perplexity_and_the_map_its_slope():
    rng = np.random.default_rng(2)
    p = maps.kernel(maps.squared_distances(rng.normal(size=(50, 4)), rng.normal(size=(80, 4))), 20.0)
    assert np.allclose(np.exp(-(p * np.log(np.maximum(p, 1e-300))).sum(1)), 20.0, rtol=1e-6) and np.allclose(p.sum(1), 1)
    y, x = blobs(120, 6, 3, apart=4.0)
    at = maps.tsne(x, 20.0)
    d, own = maps.squared_distances(at, at), maps.squared_distances(x, x)
    near, want = np.argsort(d, 1)[:, 1:11], np.argsort(own, 1)[:, 1:11]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(near, want, strict=True)]) > 0.5
    assert np.allclose(maps.place(x[:20], x, at, 15), at[:20])


def plain_transrate(pdf):
    half = lambda x: 0.5 * np.linalg.slogdet(np.cov(x.T) + 1e-4 * np.eye(x.shape[1]))[1]
    x, y = np.stack(pdf["embedding"]).astype(float), pdf["label"].to_numpy()
    return half(x) - sum((y == k).mean() * half(x[y == k]) for k in set(y))


def test_model_queries_have_sound_values(spark):
    labels = {r.label: r["count"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").groupBy("label").count().collect()}
    pad = queries.QUERIES["svm_pad"](spark, SF).collect()
    assert {r.label: r.n for r in pad} == labels and [r.pad for r in pad] == sorted(r.pad for r in pad)
    spread = queries.QUERIES["landmark_map"](spark, SF).toPandas()
    assert len(spread) == sum(labels.values()) and np.isfinite(spread[["x", "y"]].to_numpy()).all()
    guessed = queries.QUERIES["lr_predict"](spark, SF).toPandas()
    assert 0.15 * sum(labels.values()) < len(guessed) < 0.25 * sum(labels.values()) and set(guessed.prediction) <= set(labels)
    text = queries.QUERIES["tfidf_logistic"](spark, SF).toPandas()
    assert len(text) > 0 and set(text.prediction) <= {0.0, 1.0} and (text.prediction == text.label).mean() > 0.5
    assert queries.QUERIES["transrate"](spark, SF).first()[0] == pytest.approx(plain_transrate(spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()))
