"""Classification reports, learning curves, confidence intervals and significance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexarbor.functions import stats

MAX_EPOCHS, PATIENCE = 10, 2


def label_code(label: Column, codes: dict[str, int]) -> Column:
    """The code of a label; an unknown one is an error."""
    table = F.create_map(*(F.lit(x) for pair in codes.items() for x in pair))
    code = F.try_element_at(table, label)
    return F.when(code.isNull(), F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(label, F.lit("null"))))).otherwise(code)


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): n_total / (classes * n)."""
    n = rows.groupBy(label).agg(F.count("*").alias("n"))
    whole = n.agg(F.sum("n").alias("_total"), F.count("*").alias("_k"))
    return n.crossJoin(F.broadcast(whole)).select(label, "n", (F.col("_total") / (F.col("_k") * F.col("n"))).alias("weight"))  # one row


def confusion(rows: DataFrame, labels: list[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """(actual, predicted, n) for every two labels, zeros included."""
    spark = rows.sparkSession
    grid = spark.createDataFrame([(a, p) for a in labels for p in labels], "actual string, predicted string")
    n = rows.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return F.broadcast(grid).join(n, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def report(matrix: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) from a confusion matrix, by label; with accuracy, macro and weighted rows.

    A division by zero gives 0. The accuracy row holds it in all three measures.
    """
    div = lambda a, b: F.when(b == 0, 0.0).otherwise(a / F.when(b == 0, 1).otherwise(b))
    hit = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    by_actual = matrix.groupBy(F.col("actual").alias("label")).agg(F.sum("n").alias("support"), hit.alias("hit"))
    by_predicted = matrix.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("claimed"))
    each = by_actual.join(by_predicted, "label").withColumn("precision", div(F.col("hit"), F.col("claimed"))).withColumn("recall", div(F.col("hit"), F.col("support")))
    each = each.withColumn("f1", div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    measures = ("precision", "recall", "f1")
    total = F.sum("support")
    macro = each.agg(*(F.avg(m).alias(m) for m in measures), total.alias("support")).withColumn("label", F.lit("macro avg"))
    weighted = each.agg(*(div(F.sum(F.col(m) * F.col("support")), total).alias(m) for m in measures), total.alias("support")).withColumn("label", F.lit("weighted avg"))
    accuracy = each.agg(*(div(F.sum("hit"), total).alias(m) for m in measures), total.alias("support")).withColumn("label", F.lit("accuracy"))
    columns = ["label", *measures, "support"]
    return each.select(columns).unionByName(macro.select(columns)).unionByName(weighted.select(columns)).unionByName(accuracy.select(columns))


def pad_curve(curve: Column, epochs: int = MAX_EPOCHS) -> Column:
    """An array carried on with its last value to `epochs` values."""
    return F.transform(F.sequence(F.lit(1), F.lit(epochs)), lambda e: F.element_at(curve, F.least(e, F.size(curve))))


def early_stop(curve: Column, patience: int = PATIENCE) -> Column:
    """struct(best, best_epoch, stopped_at) of a run: improvements are strict, `patience` epochs without one end it."""
    state = F.struct(F.lit(float("-inf")).alias("best"), F.lit(0).alias("best_epoch"), F.lit(0).alias("epoch"), F.lit(0).alias("idle"), F.lit(False).alias("over"))

    def step(s: Column, v: Column) -> Column:
        better = v > s["best"]
        idle = F.when(better, 0).otherwise(s["idle"] + 1)
        now = s["epoch"] + 1
        moved = F.struct(F.when(better, v).otherwise(s["best"]).alias("best"), F.when(better, now).otherwise(s["best_epoch"]).alias("best_epoch"), now.alias("epoch"), idle.alias("idle"), (idle >= patience).alias("over"))
        return F.when(s["over"], s).otherwise(moved)

    return F.aggregate(curve, state, step, lambda s: F.struct(s["best"].alias("best"), s["best_epoch"].alias("best_epoch"), s["epoch"].alias("stopped_at")))


def epoch_stats(curves: DataFrame, condition: str, curve: str, epochs: int = MAX_EPOCHS) -> DataFrame:
    """(condition, epoch, mean, std): over seeds, with the population's deviation."""
    rows = curves.select(condition, F.posexplode(pad_curve(F.col(curve), epochs)).alias("i", "v"))
    return rows.groupBy(condition, (F.col("i") + 1).alias("epoch")).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def confidence(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, n, mean, margin): margin of the 95 % t interval; 0 where there is no deviation to speak of."""
    m = rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("_sem"))
    return m.withColumn("margin", F.when(F.coalesce(F.col("_sem") <= 0, F.lit(True)) | F.isnan("_sem"), 0.0).otherwise(stats.critical_t(F.col("n") - 1) * F.col("_sem"))).drop("_sem")


def deltas(rows: DataFrame, condition: str, base: str, key: str, by: list[str], value: str) -> DataFrame:
    """rows of other conditions with delta: value less the base condition's of the same key (and by)."""
    b = rows.filter(F.col(condition) == base).select(key, *by, F.col(value).alias("_base"))
    return rows.filter(F.col(condition) != base).join(b, [key, *by]).withColumn("delta", F.col(value) - F.col("_base")).drop("_base")


def confidence_of_delta(rows: DataFrame, condition: str, base: str, key: str, by: list[str], value: str) -> DataFrame:
    """confidence() of the deltas, and positive: whether the whole interval is above 0."""
    return confidence(deltas(rows, condition, base, key, by, value), [condition, *by], "delta").withColumn("positive", F.col("mean") - F.col("margin") > 0)


def t_test(rows: DataFrame, by: list[str], difference: Column) -> DataFrame:
    """(by, n, mean_difference, t, p): is the mean difference 0? Paired or, with a constant taken off, one-sample. No deviation: null."""
    m = rows.groupBy(*by).agg(F.count(difference).alias("n"), F.avg(difference).alias("mean_difference"), F.stddev_samp(difference).alias("_sd"))
    t = F.when(F.col("_sd") > 0, F.col("mean_difference") / (F.col("_sd") / F.sqrt("n")))
    return m.withColumn("t", t).withColumn("p", stats.two_sided_p(F.col("t"), F.col("n") - 1)).drop("_sd")


def best_run(rows: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """(by, order, value) of the best run; of equal ones the first in order."""
    return rows.groupBy(*by).agg(F.max_by(F.struct(order, value), F.struct(F.col(value), -F.col(order))).alias("_b")).select(*by, f"_b.{order}", f"_b.{value}")


def cartography(rows: DataFrame, key: str = "id", history: str = "history", epochs: int = 5) -> DataFrame:
    """(id, origin, confidence, variability): mean and population deviation of the first epochs; origin by the id's prefix."""
    kept = F.slice(history, 1, epochs)
    n = F.size(kept)
    mean = F.aggregate(kept, F.lit(0.0), lambda a, v: a + v) / n
    out = rows.filter(F.size(history) > 0).withColumn("confidence", mean)
    var = F.aggregate(kept, F.lit(0.0), lambda a, v: a + (v - F.col("confidence")) * (v - F.col("confidence"))) / n
    origin = F.when(F.startswith(F.col(key), F.lit("golden_")), "Organic").when(F.startswith(F.col(key), F.lit("aug_")), "Synthetic")
    return out.select(key, origin.alias("origin"), "confidence", F.sqrt(var).alias("variability"))


def anchors(mapped: DataFrame) -> DataFrame:
    """Where a map's notes go: the least variability and three quarters of the largest."""
    return mapped.agg(F.min("variability").alias("easy_x"), (0.75 * F.max("variability")).alias("hard_x"))


def axis_bound(bars: DataFrame, constant: str = "constant_delta") -> DataFrame:
    """A symmetric axis: 1.4 times the largest of |mean + margin|, |mean - margin| and |constant|; missing values don't count."""
    valid = lambda c: F.when(~F.isnan(c), F.abs(c))
    return bars.agg((1.4 * F.max(F.greatest(valid(F.col("mean") + F.col("margin")), valid(F.col("mean") - F.col("margin")), valid(F.col(constant).cast("double"))))).alias("bound"))


def metadata(train: DataFrame, test: DataFrame, aug: DataFrame | None, tapt: bool, use_aug: bool) -> DataFrame:
    """An experiment's sizes and flags; augmentation counts only if it is on and not empty."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    out = n(train, "train_size").crossJoin(n(test, "test_size"))  # one row each
    out = out.crossJoin(n(aug, "aug_size")) if aug is not None and use_aug else out.withColumn("aug_size", F.lit(0).cast("long"))
    return out.select("train_size", "test_size", "aug_size", F.lit(tapt).alias("tapt_enabled"), (F.lit(use_aug) & (F.col("aug_size") > 0)).alias("aug_enabled"))


def distance(error: Column) -> Column:
    """The proxy A-distance of an error, 2 (1 - 2 min(error, 1/2)), to four places."""
    return F.round(2 * (1 - 2 * F.least(error, F.lit(0.5))), 4)


def proxy_a_distance(predictions: DataFrame, by: list[str], actual: str, predicted: str) -> DataFrame:
    """(by, error, pad) of predictions."""
    e = predictions.groupBy(*by).agg(F.avg((F.col(actual) != F.col(predicted)).cast("double")).alias("error"))
    return e.withColumn("pad", distance(F.col("error")))


def warmup_rate(step: Column, total: int, peak: float, warmup: float = 0.1) -> Column:
    """A linear schedule: up over the first tenth of the steps, then down to 0."""
    up = max(1, int(total * warmup))
    return F.when(step < up, peak * step / up).otherwise(peak * F.greatest(F.lit(0.0), (total - step) / max(1, total - up)))
