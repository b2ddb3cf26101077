import numpy as np
from pyspark.sql import functions as F

from lexarbor.operators import network, sampling
from lexarbor.plans import queries


def rows_of(spark, n=300, d=6, k=3):
    rng = np.random.default_rng(4)
    y = rng.integers(0, k, n)
    x = rng.normal(size=(n, d)) + 2.5 * np.eye(k, d)[y]
    rows = [(i, f"c{a}", [float(v) for v in b]) for i, (a, b) in enumerate(zip(y, x, strict=True))]
    return spark.createDataFrame([*rows, (900, None, [0.0] * d), (901, "c1", None)], "id long, y string, embedding array<double>")


def test_slopes_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    net, x, y, w = network.Net(4, 3, 3, 5), rng.normal(size=(20, 4)), rng.integers(0, 3, 20), rng.random(20)
    slope, at = net.slope(x, y, w)[:-2], net.w.copy()
    for i in range(len(at)):
        told = []
        for h in (1e-6, -1e-6):
            net.w = at.copy()
            net.w[i] += h
            told.append(net.slope(x, y, w)[-2])
        assert abs((told[0] - told[1]) / 2e-6 - slope[i]) < 1e-5
    assert network.macro_f1(np.array([[2, 0, 0], [1, 1, 0], [0, 0, 0]])) == np.mean([4 / 5, 2 / 3])


def test_curves_are_those_of_one_process_at_any_number_of_tasks(spark):
    rows, conditions, seeds = rows_of(spark), {"few": 0.2, "all": 1.0}, [1, 2]
    how = {"epochs": 5, "steps": 2, "hidden": 8, "peak": 0.1}
    key = lambda r: (r[0], r[1], r[2])
    told = [sorted(map(tuple, network.learning_curves(rows.repartition(n), "id", "y", conditions, seeds, tasks=n, **how).collect()), key=key) for n in (1, 3)]
    whole = rows.filter("y is not null and embedding is not null").withColumn("code", F.substring("y", 2, 1).cast("int"))
    draws = {name: F.array(*(sampling.uniform(f"{s}{more}", F.col("id")) for s in seeds)).alias(name) for name, more in (("draw", ""), ("share", ":share"))}
    pdf = whole.select(F.col("id").alias("key"), "code", F.col("embedding").alias("x"), *draws.values()).toPandas()
    plain = network.train(network.prepared(pdf, seeds, 6), [(c, s, x) for c, s in conditions.items() for x in seeds], 6, 3, lambda a: a, 8, 5, 2, 0.1, 2, 0.2)
    for got in told:
        assert [key(r) for r in got] == sorted(key(r) for r in plain)
        assert np.allclose([r[3:7] for r in got], [r[3:7] for r in sorted(plain, key=key)], atol=1e-9) and [r[7] for r in got] == [r[7] for r in sorted(plain, key=key)]
    best = {(r[0], r[1]): r[5] for r in told[0] if r[7]}
    assert len(best) == 4 and all(best["all", s] > 0.7 for s in seeds)
    for run in best:
        f1 = [r[5] for r in told[0] if r[:2] == run]
        assert best[run] == max(f1) and len(f1) <= f1.index(max(f1)) + 3  # two epochs without a better one end a run


def test_network_runs_of_the_query(spark):
    assert network.learning_curves(rows_of(spark).limit(0), "id", "y", {"all": 1.0}, [1]).count() == 0
    told = queries.QUERIES["network_runs"](spark, "/root/testdata/sf0.001").collect()
    assert {r.condition for r in told} == {"base", "tapt", "aug", "both"} and sum(r.best for r in told) == 20 and all(0 <= r.val_macro_f1 <= 1 for r in told)
