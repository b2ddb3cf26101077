"""Cleaning, filtering and describing a corpus."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexarbor.functions import text as tx
from lexarbor.operators import features
from lexarbor.operators.dedup import ensure_checkpoints


def _made(docs: DataFrame, row: Column, keep) -> DataFrame:
    """docs with the fields of a struct, where keep(struct) holds. The generator makes Spark compute it once: filters on a
    projected expression would be pushed below it, and the expression be computed again for each."""
    return docs.withColumn("_made", F.explode_outer(F.filter(F.array(row), keep))).filter(F.col("_made").isNotNull()).select(*docs.columns, "_made.*")


def cleaned(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with clean_text and its word_count, without the empty and the short ones."""
    row = tx.let(tx.clean(F.col(text)), lambda t: F.struct(t.alias("clean_text"), tx.word_count(t).alias("word_count")))
    return _made(docs, row, lambda m: (m["clean_text"] != tx.EMPTY) & (m["word_count"] >= tx.MIN_WORDS))


def relevant(docs: DataFrame, vocabulary: list[str], least: int = tx.MIN_SCORE, dictionary: Column | None = None) -> DataFrame:
    """cleaned() docs with lemmas and score, at least `least` different words of the vocabulary."""
    row = tx.let(tx.lemmas(tx.tokens(F.col("clean_text")), dictionary), lambda words: F.struct(words.alias("lemmas"), tx.relevance(words, vocabulary).alias("score")))
    return _made(docs, row, lambda m: m["score"] >= least)


#: Rows of a lemma dictionary up to which it is broadcast; parts that a word is dealt into beyond that.
BROADCAST_ROWS, SALTS = 500_000, 16
#: Rows of a dictionary up to which it is a map, which is searched word by word.
MAP_ROWS = 32


def _replaced(table: DataFrame):
    """A function of lists of words: each word's _lemma in a table (word, _lemma) of counted size, or the word itself."""
    told = table.filter("_lemma is not null").toArrow()
    sent = table.sparkSession.sparkContext.broadcast([told.column(c).to_pylist() for c in ("word", "_lemma")])

    @F.arrow_udf("array<string>")
    def replaced(lists: pa.Array) -> pa.Array:
        known, lemma = (pa.array(c, pa.string()) for c in sent.value)
        flat = lists.flatten().dictionary_encode()
        place = pc.index_in(flat.dictionary, value_set=known)
        names = pc.coalesce(lemma.take(place), flat.dictionary.cast(pa.string()))
        offsets = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), names.take(flat.indices))

    return replaced


def lemmatised(docs: DataFrame, words: str, dictionary: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs with `lemmas` (replaced if there): each word's lemma by a table (word, lemma), in order; the word itself if it isn't there.

    A list of words has one list of lemmas, whatever rows hold it and whatever their ids, so it is looked up once, by 128 bits of its hash. Of several lemmas of a word the least counts; null words have none. A dictionary of up to broadcast_rows rows is broadcast, and the
    task that reads a row looks its words up; a larger one is joined by word and salt, so that a frequent word is no single task's.
    """
    first = dictionary.filter("word is not null").groupBy("word").agg(F.min("lemma").alias("_lemma"))
    if dictionary.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return docs.drop("lemmas").withColumn("lemmas", _replaced(first)(F.coalesce(words, F.array().cast(tx.NONE))))
    same = ["_k1", "_k2"]
    told = F.transform(words, lambda w: F.coalesce(F.concat(F.lit("="), w), F.lit("")))  # a hash passes over nulls
    keyed = docs.drop("lemmas").withColumns({"_k1": F.xxhash64(told), "_k2": F.xxhash64(F.lit(1), told)})
    each = keyed.select(*same, F.col(words).alias("_w")).dropDuplicates(same).select(*same, F.posexplode("_w").alias("_i", "word"))
    salted = first.withColumn("_s", F.explode(F.array(*(F.lit(i) for i in range(SALTS)))))
    joined = each.withColumn("_s", F.pmod(F.hash("_k1", "_i"), F.lit(SALTS))).join(salted, ["word", "_s"], "left")
    lemma = F.struct("_i", F.coalesce("_lemma", "word").alias("l"))
    lists = joined.groupBy(*same).agg(F.transform(F.array_sort(F.collect_list(lemma)), lambda x: x["l"]).alias("lemmas"))
    return keyed.join(lists, same, "left").drop(*same).withColumn("lemmas", F.coalesce("lemmas", F.array().cast(tx.NONE)))


def relevant_by_table(docs: DataFrame, vocabulary: list[str], dictionary: DataFrame, least: int = tx.MIN_SCORE) -> DataFrame:
    """relevant(), with lemmas from a table instead of a map; a table of a few rows is made one."""
    few = dictionary.filter("word is not null").groupBy("word").agg(F.min("lemma").alias("lemma")).limit(MAP_ROWS + 1).collect()
    if len(few) <= MAP_ROWS:
        pairs = [F.lit(x) for r in few if r.lemma is not None for x in (r.word, r.lemma)]
        return relevant(docs, vocabulary, least, F.create_map(*pairs) if pairs else None)
    told = lemmatised(docs.withColumn("_words", tx.tokens(F.col("clean_text"))), "_words", dictionary).drop("_words")
    return told.withColumn("score", tx.relevance(F.col("lemmas"), vocabulary)).filter(F.col("score") >= least)


def stats(docs: DataFrame, group: str, text: str = "text") -> DataFrame:
    """Per group: documents, mean words, and the mean and total characters."""
    n = tx.word_count(F.coalesce(F.col(text), F.lit("")))
    return docs.groupBy(group).agg(F.count("*").alias("n_docs"), F.round(F.avg(n), 6).alias("mean_words"), F.round(F.avg(F.length(text)), 6).alias("mean_chars"), F.sum(F.length(text)).alias("sum_chars"))


def overview(docs: DataFrame, channel: str, text: str = "text") -> DataFrame:
    """One row: texts, different channels, and the mean words of a text."""
    n = tx.word_count(F.coalesce(F.col(text), F.lit("")))
    return docs.agg(F.count("*").alias("n_docs"), F.countDistinct(channel).alias("n_channels"), F.round(F.avg(n), 6).alias("mean_words"))


#: Parts of a channel that are ranked by themselves first.
PARTS = 64


def newest(posts: DataFrame, channel: str, time: str, key: str, limit: int | None = None) -> DataFrame:
    """The `limit` newest posts of each channel (null or none: all), in the order of channel, time and key, the oldest first.

    Ranks within parts of a channel come first, so no task ranks more than a 64th of a channel, or 64 times the limit. Ties go by the larger key.
    """
    kept = posts
    if limit is not None:
        for parts in ([channel, F.pmod(F.xxhash64(key), F.lit(PARTS))], [channel]):
            kept = kept.withColumn("_r", F.row_number().over(W.partitionBy(*parts).orderBy(F.desc_nulls_last(time), F.desc_nulls_last(key)))).filter(F.col("_r") <= limit).drop("_r")
    return kept.orderBy(channel, time, key)


def ngram_totals(docs: DataFrame, low: int, high: int, text: str = "text", min_chars: int = 2) -> DataFrame:
    """(term, n) over all documents: n-grams are added up in the tasks that read them first."""
    return features.totals(docs, low, high, text, min_chars).groupBy("term").agg(F.sum("total").alias("n"))


#: Bits of the bucket that an n-gram is counted by before it is counted itself.
BUCKET_BITS = 20


def top_ngrams(docs: DataFrame, n: int = 50, low: int = 2, high: int = 2, text: str = "text", bits: int = BUCKET_BITS) -> DataFrame:
    """The n most frequent with their rank; ties by term.

    Counts by hash bucket come first, in tables of a fixed size. The n-grams of the fullest buckets are counted, and the n-th count among them is one
    that the result reaches at least, so only n-grams of buckets that hold as many are counted in the end.
    """
    ensure_checkpoints(docs.sparkSession)
    sums = features.bucket_sums(docs, low, high, bits, text).checkpoint()
    of = lambda some: features.bucket_totals(docs, low, high, bits, some.select("bucket").toArrow().column(0).to_numpy(), text)
    first = of(sums.orderBy(F.desc("held"), "bucket").limit(4 * n)).orderBy(F.desc("n"), "term").limit(n).agg(F.count("*").alias("found"), F.min("n").alias("least")).first()
    top = of(sums.filter(F.col("held") >= (first.least if first.found >= n else 0))).orderBy(F.desc("n"), "term").limit(n)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), "term")))


def compare_top(left: DataFrame, right: DataFrame, n: int = 50) -> DataFrame:
    """Two corpora's top n-grams side by side, as far as both go."""
    a, b = (top_ngrams(x, n).select("rank", F.col("term").alias(f"{s}_term"), F.col("n").alias(f"{s}_n")) for x, s in ((left, "left"), (right, "right")))
    return a.join(b, "rank")


def union(*parts: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Bag concatenation by column name; names adds where each row is from."""
    out = None
    for i, part in enumerate(parts):
        part = part if names is None else part.withColumn("dataset", F.lit(names[i]))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
