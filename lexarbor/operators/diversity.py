"""Self-BLEU and pseudo-perplexity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexarbor.functions import text as tx

ORDERS = 4


def self_bleu(texts: DataFrame, key: str, group: str, text: str = "text") -> DataFrame:
    """(group, n, self_bleu): the mean over a group's texts of BLEU-4 against all its others; null below two texts.

    No pairs: the most an n-gram occurs in any other text is the largest count in the group, or the second largest for the text that
    holds the largest. The closest other length is the nearest in the group's multiset of lengths, the shorter one on a tie.
    Orders without a match count 0.1 of a match; without a common word BLEU is 0. Joins of n-grams are told to sort: their tables look as small as the file they
    come from, and would be broadcast.
    """
    words = texts.select(group, key, tx.split_words(F.lower(F.coalesce(F.col(text), F.lit("")))).alias("words"))
    sized = words.select(group, key, F.size("words").alias("len"))
    orders = F.array(*(F.struct(F.lit(n).alias("order"), tx.word_ngrams(F.col("words"), n, n).alias("grams")) for n in range(1, ORDERS + 1)))
    grams = words.select(group, key, F.explode(orders).alias("o")).select(group, key, "o.order", F.explode("o.grams").alias("gram"))
    counts = grams.groupBy(group, "order", "gram", key).agg(F.count("*").alias("c"))
    # the largest count, in how many texts, and the next one, all by aggregates with map-side combine
    by_count = counts.groupBy(group, "order", "gram", "c").agg(F.count("*").alias("texts"))
    ranked = W.partitionBy(group, "order", "gram").orderBy(F.desc("c"))
    top = by_count.withColumn("r", F.row_number().over(ranked)).groupBy(group, "order", "gram").agg(F.max(F.when(F.col("r") == 1, F.col("c"))).alias("c1"), F.max(F.when(F.col("r") == 1, F.col("texts"))).alias("held"), F.max(F.when(F.col("r") == 2, F.col("c"))).alias("c2"))
    others = F.when((F.col("c") == F.col("c1")) & (F.col("held") == 1), F.coalesce("c2", F.lit(0))).otherwise(F.col("c1"))
    matches = counts.join(top.hint("merge"), [group, "order", "gram"]).groupBy(group, key, "order").agg(F.sum(F.least("c", others)).alias("m"), F.sum("c").alias("total"))
    wide = matches.groupBy(group, key).agg(*(F.coalesce(F.max(F.when(F.col("order") == n, F.col(c))), F.lit(0)).alias(f"{c}{n}") for n in range(1, ORDERS + 1) for c in ("m", "total")))

    lengths = sized.groupBy(group, "len").agg(F.count("*").alias("texts"))
    around = W.partitionBy(group).orderBy("len")
    near = lengths.select(group, "len", "texts", F.lag("len").over(around).alias("below"), F.lead("len").over(around).alias("above"))
    nearest = F.when(F.col("texts") > 1, F.col("len")).when(F.col("above").isNull(), F.col("below")).when(F.col("below").isNull(), F.col("above")).when(F.col("len") - F.col("below") <= F.col("above") - F.col("len"), F.col("below")).otherwise(F.col("above"))
    ref = near.select(group, "len", nearest.alias("ref"))
    per = sized.join(ref, [group, "len"]).join(wide.hint("merge"), [group, key], "left").fillna(0)
    logs = sum(F.log(F.when(F.col(f"m{n}") == 0, 0.1).otherwise(F.col(f"m{n}").cast("double")) / F.greatest(F.lit(1), F.col(f"total{n}"))) for n in range(1, ORDERS + 1)) / ORDERS
    brevity = F.when(F.col("len") > F.col("ref"), 1.0).when(F.col("len") == 0, 0.0).otherwise(F.exp(1 - F.col("ref") / F.col("len")))
    scored = per.withColumn("bleu", F.when(F.col("m1") == 0, 0.0).otherwise(brevity * F.exp(logs)))
    return scored.groupBy(group).agg(F.count("*").alias("n"), F.avg("bleu").alias("mean")).select(group, "n", F.when(F.col("n") >= 2, F.col("mean")).alias("self_bleu"))


def pseudo_perplexity(scored: DataFrame, group: str, loss: str = "loss", n: str = "n_tokens") -> DataFrame:
    """(group, pppl): exp(sum(loss * tokens) / sum(tokens)) over texts with tokens; the losses come from a model plug-in."""
    valid = scored.filter(F.col(n) > 0)
    return valid.groupBy(group).agg(F.exp(F.sum(F.col(loss) * F.col(n)) / F.sum(n)).alias("pppl"))
