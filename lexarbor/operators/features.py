"""Term weights in long form (document, term, weight), fitted on one set and applied to another.

A row's n-grams are counted by the task that reads the row (counted()), so its words aren't shuffled; rows that share a key are counted together by a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexarbor.functions import text as tx
from lexarbor.operators import dedup


#: Words that are counted together; fitted terms up to which a task has their weights at hand (16 bytes each), more are joined.
PIECE_WORDS, MOST_TERMS = 1 << 20, 2_000_000
#: Fitted terms up to which a task knows their words, too: other words are told apart by nothing then, so n-grams that hold one aren't spelled out.
MOST_WORDED = 200_000


def counted(lists: pa.Array, low: int, high: int) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
    """For each n from low to high (row, terms, number of the term, tf) of the n-grams of each row's words, sorted by row; an empty string is no word."""
    row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    flat = lists.flatten()
    some = pc.not_equal(flat, "")
    row, words = row[some.to_numpy(zero_copy_only=False)], pc.cast(flat.filter(some), pa.large_string()).dictionary_encode()
    word = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    size, code, names = max(1, len(words.dictionary)), word, words.dictionary
    for n in range(1, high + 1):
        if n > 1:
            code, back = np.unique(code[: len(word) - n + 1] * size + word[n - 1 :] if len(word) >= n else word[:0], return_inverse=True)
            names, code = pc.binary_join_element_wise(names.take(pa.array(code // size)), words.dictionary.take(pa.array(code % size)), pa.scalar(" ", pa.large_string())), back
        if n >= low:
            begins = np.flatnonzero(row[: len(code)] == row[n - 1 :]) if len(code) else code
            held, tf = np.unique(row[begins] * max(1, len(names)) + code[begins], return_counts=True)
            yield held // max(1, len(names)), names, held % max(1, len(names)), tf


def _pieces(batches) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(keys, words) of rows of about PIECE_WORDS words."""
    for batch in batches:
        keys, lists = batch.column(0), pc.split_pattern(batch.column(1), "\n")
        upto = np.cumsum(np.r_[0, pc.list_value_length(lists).to_numpy(zero_copy_only=False)])
        at = 0
        while at < len(lists):
            end = max(at + 1, int(np.searchsorted(upto, upto[at] + PIECE_WORDS, side="right")) - 1)
            yield keys.slice(at, end - at), lists.slice(at, end - at)
            at = end


def _worded(docs: DataFrame, key, text: str, min_chars: int = 2) -> DataFrame:
    """(key, words), the words in one string: lists of strings are slow to hand over."""
    return docs.select(key, F.array_join(tx.tokens(F.coalesce(F.col(text), F.lit("")), min_chars), "\n").alias("words"))


def totals(docs: DataFrame, low: int, high: int, text: str = "text", min_chars: int = 2) -> DataFrame:
    """(term, df, total), several rows a term: n-grams of the rows, added up in each task's pieces."""

    def run(batches):
        for _, lists in _pieces(batches):
            for _, names, code, tf in counted(lists, low, high):
                df, total = np.bincount(code, minlength=len(names)), np.bincount(code, tf, len(names)).astype(np.int64)
                some = np.flatnonzero(df)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(some)).cast(pa.string()), pa.array(df[some]), pa.array(total[some])], names=["term", "df", "total"])

    return _worded(docs, F.lit(0), text, min_chars).mapInArrow(run, "term string, df long, total long")


def _bucketed(lists: pa.Array, low: int, high: int, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """For each n (n, first words of the n-grams, their buckets by hash, numbers of the words, the words)."""
    row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    flat = lists.flatten()
    some = pc.not_equal(flat, "")
    row, words = row[some.to_numpy(zero_copy_only=False)], pc.cast(flat.filter(some), pa.large_string()).dictionary_encode()
    word, own = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.fromiter((_code(t) for t in words.dictionary.to_pylist()), np.int64, len(words.dictionary)).view(np.uint64)
    for n in range(low, high + 1):
        begins = np.flatnonzero(row[: max(0, len(row) - n + 1)] == row[n - 1 :])
        h = np.full(len(begins), n, np.uint64)
        for j in range(n):
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + own[word[begins + j]]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        yield n, begins, (h >> np.uint64(64 - bits)).astype(np.int64), word, words.dictionary


def bucket_sums(docs: DataFrame, low: int, high: int, bits: int, text: str = "text", min_chars: int = 2) -> DataFrame:
    """(bucket, held): how often the n-grams of each of 2^bits buckets occur."""

    def run(batches):
        held = np.zeros(1 << bits, np.int64)
        for _, lists in _pieces(batches):
            for _, _, bucket, _, _ in _bucketed(lists, low, high, bits):
                held += np.bincount(bucket, minlength=len(held))
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["bucket", "held"])

    return _worded(docs, F.lit(0), text, min_chars).mapInArrow(run, "bucket long, held long").groupBy("bucket").agg(F.sum("held").alias("held"))


def bucket_totals(docs: DataFrame, low: int, high: int, bits: int, buckets: np.ndarray, text: str = "text", min_chars: int = 2) -> DataFrame:
    """(term, n): how often the n-grams of some of the buckets occur."""
    passes = np.zeros(1 << bits, bool)
    passes[buckets] = True
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(passes))

    def run(batches):
        passes = np.unpackbits(sent.value).astype(bool)
        for _, lists in _pieces(batches):
            for n, begins, bucket, word, names in _bucketed(lists, low, high, bits):
                begins = begins[passes[bucket]]
                grams, n_times = np.unique(np.stack([word[begins + j] for j in range(n)]), axis=1, return_counts=True) if n != 2 else _pairs(word[begins], word[begins + 1])
                term = pc.binary_join_element_wise(*(names.take(pa.array(g)) for g in grams), pa.scalar(" ", pa.large_string())) if n > 1 else names.take(pa.array(grams[0]))
                yield pa.RecordBatch.from_arrays([term.cast(pa.string()), pa.array(n_times)], names=["term", "n"])

    return _worded(docs, F.lit(0), text, min_chars).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    code, n = np.unique((a << 32) | b, return_counts=True)
    return np.stack([code >> 32, code & 0xFFFFFFFF]), n


def alone(docs: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """(rows whose key no other row has, the others or none)."""
    again = docs.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col(key).alias("_again"))
    if again.isEmpty():
        return docs, None
    same = docs[key].eqNullSafe(F.col("_again"))
    return docs.join(again, same, "left_anti"), docs.join(again, same, "left_semi")


def frequencies(docs: DataFrame, key: str, low: int = 1, high: int = 2, text: str = "text") -> DataFrame:
    """(term, df, total) of the documents' n-grams, as term_counts() would give them."""
    single, again = alone(docs, key)
    parts = totals(single, low, high, text)
    if again is not None:
        parts = parts.unionByName(term_counts(again, key, low, high, text).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")))
    return parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def _code(term: str) -> int:
    return int(hashlib.md5(term.encode()).hexdigest()[:15], 16)


def _masked(lists: pa.Array, words: pa.Array) -> pa.Array:
    """The lists with one and the same mark, which no text has, in the place of all words but these."""
    flat, n = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    kept = pc.if_else(pc.is_in(flat, value_set=words.cast(flat.type)), flat, pa.scalar("\n", flat.type))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), kept)


def _weigher(spark, terms: DataFrame, low: int, high: int, sublinear: bool):
    """(keys, words) batches to (keys, row, term, number of the term, w) of the fitted terms, vectors of length one; terms (term, idf, i)."""
    code = F.conv(F.substring(F.md5("term"), 1, 15), 16, 10).cast("long")
    table = terms.select(code.alias("h"), F.col("idf").cast("double").alias("idf"), F.col("i").cast("long").alias("i")).toArrow().combine_chunks()
    own, idf, number = (table.column(c).to_numpy() for c in ("h", "idf", "i"))
    order = np.argsort(own)
    words = [r.w for r in terms.select(F.explode(F.split("term", " ")).alias("w")).distinct().collect()] if len(own) <= MOST_WORDED else None
    sent = spark.sparkContext.broadcast((own[order], idf[order], number[order], words))

    def run(batches):
        h, idf, number, words = sent.value
        for keys, lists in _pieces(batches):
            lists = lists if words is None else _masked(lists, pa.array(["", *words], pa.string()))
            rows, names, codes, ws, at = [], [], [], [], []
            for row, term, code, tf in counted(lists, low, high):
                mine = np.fromiter((_code(t) for t in term.to_pylist()), np.int64, len(term))
                place = np.minimum(np.searchsorted(h, mine), max(0, len(h) - 1))
                known = (h[place] == mine) if len(h) else np.zeros(len(mine), bool)
                ok = known[code]
                row, code, tf = row[ok], code[ok], tf[ok].astype(np.float64)
                rows.append(row)
                ws.append((1 + np.log(tf) if sublinear else tf) * idf[place[code]])
                names.append(term.take(pa.array(code)).cast(pa.string()))
                at.append(number[place[code]])
            row, w, at = np.concatenate(rows), np.concatenate(ws), np.concatenate(at)
            yield keys, row, pa.concat_arrays(names), at, w / np.sqrt(np.bincount(row, w * w, len(keys)))[row]

    return run


def weighted(docs: DataFrame, terms: DataFrame, key: str, low: int = 1, high: int = 2, sublinear: bool = False, text: str = "text", most: int = MOST_TERMS) -> DataFrame:
    """tfidf() of the documents' n-grams, without a shuffle as long as the fitted terms are no more than `most`."""
    dedup.ensure_checkpoints(docs.sparkSession)
    terms = terms.select("term", "idf").checkpoint()
    if terms.count() > most:
        return tfidf(term_counts(docs, key, low, high, text), terms, key, sublinear)
    single, again = alone(docs, key)
    weigh = _weigher(docs.sparkSession, terms.withColumn("i", F.lit(0)), low, high, sublinear)

    def run(batches):
        for keys, row, term, _, w in weigh(batches):
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(row)), term, pa.array(w)], names=[key, "term", "w"])

    schema = T.StructType([docs.schema[key], T.StructField("term", T.StringType()), T.StructField("w", T.DoubleType())])
    told = _worded(single, key, text).mapInArrow(run, schema)
    return told if again is None else told.unionByName(tfidf(term_counts(again, key, low, high, text), terms, key, sublinear))


def packed(docs: DataFrame, terms: DataFrame, key: str, low: int = 1, high: int = 2, sublinear: bool = False, text: str = "text") -> DataFrame:
    """(key, t): the weights as (i, w) by number, one row a document, which has a key of its own; terms (term, idf, i), no more than MOST_TERMS."""
    weigh = _weigher(docs.sparkSession, terms, low, high, sublinear)

    def run(batches):
        for keys, row, _, at, w in weigh(batches):
            order = np.lexsort((at, row))
            offsets = np.searchsorted(row[order], np.arange(len(keys) + 1)).astype(np.int32)
            pairs = pa.StructArray.from_arrays([pa.array(at[order]), pa.array(w[order])], names=["i", "w"])
            yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(offsets), pairs)], names=[key, "t"])

    pair = T.StructType([T.StructField("i", T.LongType()), T.StructField("w", T.DoubleType())])
    return _worded(docs, key, text).mapInArrow(run, T.StructType([docs.schema[key], T.StructField("t", T.ArrayType(pair))]))


def term_counts(docs: DataFrame, key: str, low: int = 1, high: int = 2, text: str = "text") -> DataFrame:
    """(key, term, tf) of word n-grams of words of two characters at least."""
    return docs.select(key, F.explode(tx.word_ngrams(tx.tokens(F.coalesce(F.col(text), F.lit("")), 2), low, high)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def fit(counts: DataFrame, n_docs: int, min_df: int = 1, max_df: float = 1.0, max_features: int | None = None) -> DataFrame:
    """(term, df, total, idf): smooth idf ln((1 + n) / (1 + df)) + 1 of the terms within the document-frequency bounds.

    max_features keeps the terms of largest total count; ties by term.
    """
    return chosen(counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")), n_docs, min_df, max_df, max_features)


def chosen(terms: DataFrame, n_docs: int, min_df: int = 1, max_df: float = 1.0, max_features: int | None = None) -> DataFrame:
    """fit() of terms (term, df, total) that have been counted."""
    terms = terms.filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
    if max_features is not None:
        terms = terms.orderBy(F.desc("total"), "term").limit(max_features)
    return terms.withColumn("idf", F.log((1.0 + n_docs) / (1 + F.col("df"))) + 1)


def tfidf(counts: DataFrame, terms: DataFrame, key: str, sublinear: bool = False) -> DataFrame:
    """(key, term, w) with vectors of length one; terms that weren't fitted are left out."""
    tf = 1 + F.log(F.col("tf")) if sublinear else F.col("tf")
    raw = counts.join(terms.select("term", "idf"), "term").select(key, "term", (tf * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(key)))
    return raw.select(key, "term", (F.col("w") / norm).alias("w"))
