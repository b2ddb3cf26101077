"""Phrase collocation mining: n-grams as rows, counted per language, scored by their weakest cut.

Texts, A-Z lower-cased, are split at .,;:!? and line ends into pieces and these at blanks and tabs into words. All phrases of 1 to max_n words
within a piece become rows (lang, phrase, c), hash-aggregated per language; a null lang is `und`.

Phrases of two words are exploded after words have been counted, and longer ones after those of two, and only where all their words, or pairs of words, were found often
enough: a phrase occurs no oftener than its parts, so this leaves out only what can't be a candidate. The parts are looked up in a bitmap of fixed size (64 MB
at most) of their hashes, which may let more pass and never fewer; counts are of the phrases themselves, as strings, and exact. Rows of one stretch of text are combined before they leave Python.
Most pairs of frequent words are rare. So pairs are counted by hash first, in buckets whose numbers (sorted, as differences) and counts take about a byte each: one whose bucket
has fewer occurrences than asked for can't have more, and isn't exploded. There are up to 2^29 buckets; if these fill, more pairs are exploded, never fewer.

Each cut of a candidate looks up the counts of both sides (hot sides by broadcast, see common.lookup); scores are quotients of exact decimals. A
candidate goes if a phrase one word longer has as many occurrences: what lies in a longer one of that count lies in one of one more word, too.
The first `top` of a language are found by a window with a limit before the shuffle.

Null and empty texts have no words. Rows that repeat count each time. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexarbor.llm import common
from lexarbor.llm.kernels import U64, mix, pieces, powers

#: The largest bitmap of phrases: 2^29 bits, 64 MB.
MOST_BITS = 29
#: Buckets of one row of the sketch.
RANGE = 1 << 15
#: Bytes of text whose phrases are combined before they become rows.
STRETCH = 1 << 20


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each byte: 0 in words, 1 between words, 2 between pieces; and the byte with A-Z lower-cased, or a blank outside of words."""
    kind, shown = np.zeros(256, np.uint8), np.arange(256, dtype=np.uint8)
    kind[[0x20, 0x09]] = 1
    kind[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
    shown[0x41:0x5B] += 32
    shown[kind > 0] = 0x20
    return kind, shown


KIND, SHOWN = _tables()


def packed_words(data: np.ndarray, rows: np.ndarray):
    """Words as bytes with one blank after each, where each begins and ends there, its row, and whether the next word is of the same piece.

    Every row ends with a byte between pieces.
    """
    kind = KIND[data]
    inside = kind == 0
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    edge = np.r_[0, edge] if len(data) and inside[0] else edge
    starts, ends = edge[::2], edge[1::2]
    inside[ends] = True  # the blank after a word
    flat = SHOWN[data[inside]]
    end = np.cumsum(ends - starts + 1) - 1
    begin = end - (ends - starts)
    piece = np.searchsorted(np.flatnonzero(kind == 2), starts)
    same = np.zeros(len(starts), bool)
    same[:-1] = piece[1:] == piece[:-1]
    return flat, begin, end, np.searchsorted(rows, starts, side="right") - 1, same


@functools.lru_cache(4096)
def _salt(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def gram_hashes(flat: np.ndarray, begin: np.ndarray, end: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges, by language."""
    up, down = powers(len(flat) + 1)
    total = np.r_[U64(0), np.cumsum(flat.astype(U64) * up[: len(flat)], dtype=U64)]
    return mix(mix((total[end] - total[begin]) * down[begin]) ^ salts)


def strings(flat: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte ranges as an array of strings."""
    size = end - begin
    offsets = np.r_[0, np.cumsum(size)]
    at = np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], size)
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat[at]))


class Filter:
    """A bitmap of phrases' hashes at the tasks."""

    def __init__(self, spark, bitmap: np.ndarray, bits: int):
        self.shared, self.bits = spark.sparkContext.broadcast(bitmap), bits

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        return common.probe(self.shared.value, hashes, self.bits)


def grams(batch: pa.RecordBatch, sizes: list[int], part: int, passes: Filter | None, stretch: int):
    """(names of languages, code of each word's one, bytes, begins and ends of words, k, first words, hash function) of the phrases of `sizes` words in (lang, text) whose parts of `part` words all pass."""
    langs = batch.column(0).dictionary_encode()
    names = pa.array(langs.dictionary.to_pylist(), pa.string())
    code, salt = langs.indices.to_numpy(), np.array([_salt(x) for x in names.to_pylist()], U64)
    for at, data, rows in pieces(batch.column(1), stretch):
        flat, begin, end, row, same = packed_words(data, rows)
        lang = code[at + row]
        hashes = lambda first, k: gram_hashes(flat, begin[first], end[first + k - 1], salt[lang[first]])  # noqa: B023, E731
        first, known = np.arange(len(begin)), np.ones(len(begin), bool)
        for k in range(1, sizes[-1] + 1):
            if k > 1:
                first = first[same[first + k - 2]]  # the last word's is false
            if k == part:
                known = np.zeros(len(begin), bool)
                known[first] = passes(hashes(first, k))
            if k >= part:
                first = first[known[first + k - max(part, 1)]]
            if k in sizes and len(first):
                yield names, lang, flat, begin, end, k, first, hashes


def sketcher(k: int, part: int, passes: Filter, bits: int, stretch: int = STRETCH):
    """(lang, text) to (range, block): how often buckets of phrases of k words occur in a batch, by ranges of buckets."""

    def run(batches):
        for batch in batches:
            found = [(hashes(first, k) & U64((1 << bits) - 1)).astype(np.uint32) for *_, first, hashes in grams(batch, [k], part, passes, stretch)]
            bucket, c = np.unique(np.concatenate([*found, np.zeros(0, np.uint32)]), return_counts=True)
            numbers, cuts = np.unique(bucket // RANGE, return_index=True)
            blocks = []
            for a, b in zip(cuts, np.r_[cuts[1:], len(bucket)], strict=True):
                step = np.diff(bucket[a:b] % RANGE, prepend=0).astype("<u2")
                blocks.append(zlib.compress(step.tobytes() + np.minimum(c[a:b], 255).astype(np.uint8).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([pa.array(numbers.astype(np.int32)), pa.array(blocks, pa.binary())], names=["range", "block"])

    return run


def adder(least: int):
    """(range, block) sorted by range to (range, bitmap) of the buckets with `least` occurrences or more; a block's count of 255 stands for any beyond, too."""
    most = 1 << 40

    def told(number, total):
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())], names=["range", "bitmap"])

    def run(batches):
        number, total = None, None
        for batch in batches:
            for n, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if n != number:
                    if number is not None:
                        yield told(number, total)
                    number, total = n, np.zeros(RANGE, np.int64)
                raw = zlib.decompress(block)
                size = len(raw) // 3
                at, c = np.cumsum(np.frombuffer(raw, "<u2", size)), np.frombuffer(raw, np.uint8, size, 2 * size)
                total[at] += np.where(c == 255, np.int64(most), c.astype(np.int64))
        if number is not None:
            yield told(number, total)

    return run


def often(texts: DataFrame, k: int, part: int, passes: Filter, words: int, least: int) -> Filter:
    """Lets all phrases of k words pass that occur `least` times or more, and those that share a bucket with such or with many others."""
    bits = min(MOST_BITS, max(15, (words // 8).bit_length()))
    blocks = texts.mapInArrow(sketcher(k, part, passes, bits), "range int, block binary").repartition("range").sortWithinPartitions("range")
    table = np.zeros((1 << bits) // 8, np.uint8)
    told = blocks.mapInArrow(adder(least), "range int, bitmap binary").toArrow()
    for number, raw in zip(told.column(0).to_pylist(), told.column(1).to_pylist(), strict=True):
        table[number * RANGE // 8 : (number + 1) * RANGE // 8] = np.frombuffer(raw, np.uint8)
    return Filter(texts.sparkSession, table, bits)


def exploder(sizes: list[int], part: int = 0, passes: Filter | None = None, itself: Filter | None = None, stretch: int = STRETCH):
    """(lang, text) to (lang, phrase, c) of the phrases of so many words (sizes, in order, beyond part) whose parts of `part` words, and if asked for that themselves, pass.

    With phrases of one word, rows without a phrase hold the number of all words.
    """

    def run(batches):
        for batch in batches:
            for names, lang, flat, begin, end, k, first, hashes in grams(batch, sizes, part, passes, stretch):
                if itself is not None:
                    first = first[itself(hashes(first, k))]
                counted = pa.table({"lang": lang[first].astype(np.int64), "phrase": strings(flat, begin[first], end[first + k - 1])}).group_by(["lang", "phrase"]).aggregate([([], "count_all")])
                lang_of, phrase, c = (counted.column(x).combine_chunks() for x in ("lang", "phrase", "count_all"))
                if k == 1:
                    n = np.bincount(lang, minlength=len(names))
                    some = np.flatnonzero(n)
                    lang_of, phrase, c = (pa.concat_arrays(x) for x in ((lang_of, pa.array(some)), (phrase, pa.nulls(len(some), phrase.type)), (c, pa.array(n[some]))))
                yield pa.RecordBatch.from_arrays([names.take(lang_of), phrase.cast(pa.string()), c], names=["lang", "phrase", "c"])

    return run


def hasher(batches):
    """(lang, phrase) to (h): their hashes as exploder() has them."""
    for batch in batches:
        salt = np.array([_salt(x) for x in batch.column(0).to_pylist()], U64)
        for at, data, rows in pieces(batch.column(1)):
            h = gram_hashes(data, rows[:-1], rows[1:], salt[at : at + len(rows) - 1])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])


def counts(docs: DataFrame, max_n: int = 5, least: int = 100) -> list[DataFrame]:
    """Written tables (lang, phrase, f) of the phrases with at least `least` occurrences: of one word, of two, and of all longer ones; the first also has all words of each language, without a phrase."""
    spark = docs.sparkSession
    ended = F.concat(F.coalesce(docs["text"].cast("string"), F.lit("")), F.lit("\n"))
    texts = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"), ended.alias("text"))
    out, passes, itself = [], None, None
    for part, sizes in enumerate(([1], [2], list(range(3, max_n + 1)))):
        if not sizes or sizes[0] > max_n:
            break
        if sizes == [2]:
            itself = often(texts, 2, 1, passes, out[0].filter("phrase is null").agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0], least)
        counted = texts.mapInArrow(exploder(sizes, part, passes, itself), "lang string, phrase string, c long").groupBy("lang", "phrase").agg(F.sum("c").alias("f"))
        out.append(common.saved(counted.filter((F.col("f") >= least) | F.col("phrase").isNull()), f"grams-{sizes[0]}"))
        keys = out[-1].filter("phrase is not null").select("lang", "phrase")
        n = keys.count()
        if not n:
            break
        bits, itself = min(MOST_BITS, max(15, (64 * n).bit_length())), None
        passes = Filter(spark, common.bitmap(keys.mapInArrow(hasher, "h long"), "h", bits), bits)
    return out


def scored(levels: list[DataFrame]) -> DataFrame:
    """(lang, phrase, k, a, l, r, n, score) of every phrase of two or more words, by its lowest-scoring cut."""
    every = functools.reduce(DataFrame.unionByName, [t.filter("phrase is not null") for t in levels])
    ws = F.split("phrase", " ")
    found = functools.reduce(DataFrame.unionByName, levels[1:]).select("lang", "phrase", F.size(ws).alias("k"), F.col("f").alias("a"))
    cuts = found.select("lang", "phrase", "k", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    side = lambda name, part: F.struct(F.lit(name).alias("side"), F.array_join(part, " ").alias("part"))
    sides = cuts.select("lang", "phrase", "k", "a", "cut", F.explode(F.array(side("l", F.slice(ws, F.lit(1), F.col("cut"))), side("r", F.slice(ws, F.col("cut") + 1, F.col("k") - F.col("cut"))))).alias("s")).select("lang", "phrase", "k", "a", "cut", "s.side", "s.part")
    sides = common.saved(sides, "sides")
    asked = sides.groupBy("lang", "part").agg(F.count("*").alias("uses"))
    asked = common.saved(asked.join(every.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"]), "asked")
    both = common.lookup(sides, asked, ["lang", "part"], "uses").groupBy("lang", "phrase", "k", "a", "cut").agg(F.max(F.when(F.col("side") == "l", F.col("f"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("f"))).alias("r"))
    both = common.saved(both, "cuts")
    totals = levels[0].filter("phrase is null").select("lang", F.col("f").alias("n"))
    totals = common.saved(totals.join(both.groupBy("lang").agg(F.count("*").alias("rows")), "lang"), "totals")
    exact = lambda c: f"cast({c} as decimal(18, 0))"
    score = F.expr(f"({exact('1000 * a')} * {exact('n')}) div ({exact('l')} * {exact('r')})")
    least = common.lookup(both, totals, "lang", "rows").groupBy("lang", "phrase", "k", "a", "n").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("low"))
    return least.select("lang", "phrase", "k", "a", "low.l", "low.r", "n", "low.score")


def collocations(docs: DataFrame, max_n: int = 5, least: int = 100, top: int = 2000) -> DataFrame:
    """Each language's first `top` phrases by score: lang, rank, phrase, a, l, r, n, score.

    a, l, r: occurrences of the phrase and of both sides of its lowest-scoring cut; n: words of the language; score: floor(1000 a n / (l r)).
    """
    levels = counts(docs, max_n, least)
    if len(levels) < 2:
        return docs.sparkSession.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    found = common.saved(scored(levels), "scored")
    ws = F.split("phrase", " ")
    parts = F.explode(F.array(F.array_join(F.slice(ws, F.lit(1), F.col("k") - 1), " "), F.array_join(F.slice(ws, F.lit(2), F.col("k") - 1), " ")))
    longer = found.filter("k > 2").select("lang", parts.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = found.alias("c").join(longer.alias("x"), (F.col("c.lang") == F.col("x.lang")) & (F.col("c.phrase") == F.col("x.phrase")) & (F.col("x.longer") >= F.col("c.a")), "left_anti")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return kept.withColumn("rank", rank).filter(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
