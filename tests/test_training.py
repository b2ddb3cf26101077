import hashlib
import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lexarbor.operators import masked, training


def u(x):
    return int(hashlib.md5(x.encode()).hexdigest()[:8], 16) / 2**32


def test_runs_are_plain_nearest_centroids(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(y), [float(v) for v in rng.normal(y, 1.5, 4)]) for i, y in enumerate(rng.integers(0, 3, 200))]
    shares, seeds = {"few": 0.3, "all": 1.0}, [1, 2]
    df = spark.createDataFrame([*rows, (900, None, [0.0] * 4), (901, 1, None)], "id long, y int, e array<double>").repartition(5)
    told = training.runs(df, "id", "y", shares, seeds, 5, "e")
    got = {(r.condition, r.seed, r.epoch, r.id): (r.actual, r.predicted) for r in told.collect()}
    want = {}
    for s in seeds:
        held = [r for r in rows if u(f"{s}:{r[0]}") < 0.2]
        for c, share in shares.items():
            learned = [(min(4, math.floor((u(f"{s}:{i}") - 0.2) / 0.8 * 5)), y, x) for i, y, x in rows if u(f"{s}:{i}") >= 0.2 and u(f"{s}:share:{i}") < share]
            for e in range(1, 6):
                means = {k: np.mean([x for st, y, x in learned if y == k and st < e], axis=0) for k in {y for st, y, _ in learned if st < e}}
                for i, y, x in held:
                    want[c, s, e, i] = (y, min(means, key=lambda k: (np.linalg.norm(np.array(x) - means[k]), k)))
    assert got == want
    each = training.scores(told)
    f1 = {}
    for (c, s, e, _), (y, p) in want.items():
        n = f1.setdefault((c, s, e), Counter())
        n[y, "support"] += 1
        n[p, "claimed"] += 1
        n[y, "hit"] += y == p
    plain = {(c, s, e): {k: 2 * n[k, "hit"] / (n[k, "support"] + n[k, "claimed"]) for k in {k for k, _ in n}} for (c, s, e), n in f1.items()}
    assert {(r.condition, r.seed, r.epoch, r.label): r.f1 for r in each.collect()} == {(*run, k): round(v, 9) for run, labels in plain.items() for k, v in labels.items()}
    curve = {(r.condition, r.seed): r.curve for r in training.curves(each).collect()}
    assert all(abs(v - np.mean(list(plain[c, s, e].values()))) < 1e-6 for (c, s), values in curve.items() for e, v in enumerate(values, 1))
    best = {(r.condition, r.seed, r.metric): r.value for r in training.metrics(each, F.col("label") == 0, "f1_zero").collect()}
    assert all(best[c, s, "f1_macro"] == max(values) and best[c, s, "f1_zero"] == round(plain[c, s, values.index(max(values)) + 1].get(0, 0), 9) for (c, s), values in curve.items())
    assert training.runs(df.limit(0), "id", "y", shares, seeds, 5, "e").count() == 0


def plain_losses(train, texts, most):
    tri = Counter()
    for ws in train:
        w = ["", *ws, ""]
        tri.update((w[i - 1], w[i], w[i + 1]) for i in range(1, len(w) - 1))
    one, total = Counter(), sum(tri.values())
    for (_, w, _), n in tri.items():
        one[w] += n

    def mixed(chosen, w, low):
        n, t = sum(chosen.values()), len(chosen)
        return (chosen[w] + t * low) / (n + t) if n else low

    def by(test):
        out = Counter()
        for (x, w, y), n in tri.items():
            if test(x, y):
                out[w] += n
        return out

    out = []
    for ws in texts:
        w = ["", *ws[:most], ""]
        logs = []
        for i in range(1, len(w) - 1):
            p0 = (one[w[i]] + 1) / (total + len(one) + 1)
            p1 = (mixed(by(lambda x, y: x == w[i - 1]), w[i], p0) + mixed(by(lambda x, y: y == w[i + 1]), w[i], p0)) / 2
            logs.append(math.log(mixed(by(lambda x, y: (x, y) == (w[i - 1], w[i + 1])), w[i], p1)))
        if logs:
            out.append((round(-sum(logs) / len(logs), 9), len(logs)))
    return out


def test_token_losses_are_plain_ones(spark):
    rng = random.Random(4)
    words = ["a", "bb", "c1", "Ünd", "the"]
    say = lambda n, more=(): [rng.choice([*words, *more]) for _ in range(n)]
    train, texts = [say(rng.randrange(12)) for _ in range(40)], [say(rng.randrange(15), ["unseen"]) for _ in range(30)] + [say(200)]
    df = lambda rows: spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)] + [(1000, None), (1001, "...")], "id long, text string")
    got = [(round(r.loss, 9), r.n_tokens) for r in masked.losses(masked.fit(df(train)), df(texts), "id").orderBy("id").collect()]
    low = lambda rows: [[w.lower() for w in t] for t in rows]
    assert got == plain_losses(low(train), low(texts), masked.MOST) and got[-1][1] == masked.MOST
    # without anything counted a word is one of one
    assert [r.loss for r in masked.losses(masked.fit(df(train).limit(0)), df(texts[:3]), "id").collect()] == [0.0] * len([t for t in texts[:3] if t])
    assert masked.losses(masked.fit(df(train)), df(texts).limit(0), "id").count() == 0


def test_f5_f6_losses_are_of_whole_texts_in_any_pieces(spark, monkeypatch):
    rng = random.Random(5)
    say = lambda n, of: [rng.choice(of) for _ in range(n)]
    some = [f"w{i}" for i in range(9)]
    train, texts = [say(rng.randrange(40), some) for _ in range(30)], [say(rng.randrange(60), [*some, "odd"]) for _ in range(20)] + [say(300, some)]
    df = lambda rows: spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)], "id long, text string")
    want = plain_losses(train, texts, None)
    assert max(n for _, n in want) == 300
    for together, chunk in ((1 << 21, 1 << 19), (50, 70)):
        monkeypatch.setattr(masked, "TOGETHER", together)
        monkeypatch.setattr(masked, "CHUNK", chunk)
        got = masked.losses(masked.fit(df(train)), df(texts), "id", most=None)
        assert [(round(r.loss, 9), r.n_tokens) for r in got.orderBy("id").collect()] == want
    # rows of one key, or of none, are one
    twice = spark.createDataFrame([(1, "w1 w2"), (1, "w3"), (None, "w4")], "id long, text string")
    assert sorted((r.id or 0, r.n_tokens) for r in masked.losses(masked.fit(df(train)), twice, "id").collect()) == [(0, 1), (1, 3)]


def test_f5_f6_registered_losses_leave_no_word_out(spark):
    from lexarbor.functions import text as tx
    from lexarbor.plans import oracle, queries

    d = "/root/testdata/sf0.001"
    told = queries.QUERIES["token_losses"](spark, d).select("doc_id", "n_tokens")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    n = {r.doc_id: r.n for r in docs.selectExpr("doc_id", "text").withColumn("n", F.size(tx.tokens(F.col("text")))).collect()}
    got = {r.doc_id: r.n_tokens for r in told.collect()}
    assert got == {i: n[i] for i in got} and max(got.values()) > masked.MOST
    assert "128" not in oracle.SQL["pseudo_perplexity"].split("losses as")[0].split("a as")[1]
