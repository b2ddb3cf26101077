"""Lemmas of words that no dictionary has, by suffix rules induced from one that there is.

A pair of the dictionary gives a rule: how many letters of the word's end go, and what comes instead. Every ending of the word of up to `longest` letters that the
rule can be told from is a context of it. Rules are counted by context; a context keeps the rule that most pairs have (ties: the fewest letters go, then
by the letters that come). An unknown word takes the rule of its longest context that at least `support` pairs have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _endings(word: Column, least: Column, longest: int) -> Column:
    """The word's last `least` to `longest` letters, never the whole word."""
    most = F.least(F.lit(longest), F.length(word) - 1)
    return F.when(most >= least, F.transform(F.sequence(least, most), lambda k: F.right(word, k))).otherwise(F.array().cast("array<string>"))


def rules(pairs: DataFrame, longest: int = 5, support: int = 2) -> DataFrame:
    """(ending, cut, put, n) from (word, lemma): for words with this ending `cut` letters go and `put` comes, as `n` pairs have it. Rows with nulls don't count, equal ones once."""
    least = F.least(F.length("word"), F.length("lemma"))
    same = F.coalesce(F.array_max(F.filter(F.sequence(F.lit(0), least), lambda k: F.left("word", k) == F.left("lemma", k))), F.lit(0))
    told = pairs.select("word", "lemma").dropna().distinct().withColumn("_same", same)
    told = told.withColumn("cut", F.length("word") - F.col("_same")).withColumn("put", F.substr("lemma", F.col("_same") + 1))
    each = told.select("cut", "put", F.explode(_endings(F.col("word"), F.col("cut"), longest)).alias("ending"))
    counted = each.groupBy("ending", "cut", "put").agg(F.count("*").alias("n")).filter(F.col("n") >= support)
    best = counted.groupBy("ending").agg(F.min(F.struct((-F.col("n")).alias("less"), "cut", "put")).alias("b"))
    return best.select("ending", "b.cut", "b.put", (-F.col("b.less")).alias("n"))


def guessed(words: DataFrame, table: DataFrame, longest: int = 5) -> DataFrame:
    """words (with a column word) and lemma: by the rule of the longest ending in the table, the word itself without one. Each different word is looked up once."""
    different = words.select("word").filter(F.col("word").isNotNull()).distinct()
    asked = different.select("word", F.explode(_endings(F.col("word"), F.lit(0), longest)).alias("ending"))
    found = asked.join(table.select("ending", "cut", "put"), "ending").groupBy("word").agg(F.max(F.struct(F.length("ending").alias("size"), "cut", "put")).alias("r"))
    made = found.select("word", F.concat(F.left("word", F.length("word") - F.col("r.cut")), F.col("r.put")).alias("lemma"))
    return words.drop("lemma").join(made, "word", "left").withColumn("lemma", F.coalesce("lemma", "word"))
