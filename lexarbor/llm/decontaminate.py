"""Benchmark decontamination by winnowing.

Both sides keep, of each run of 13 words, the first smallest hash of its k-grams (k = 8, so six per run): texts that
share 13 words share a fingerprint. Items of fewer words are fingerprinted whole, and documents by their runs of these
lengths. Fingerprints that both sides hold are joined, and a hit is extended word by word to both sides: each
fingerprint carries the hashes of the words around it, as far as a window that holds it can reach, so neither texts nor
items are needed again, however long they are.

A document's fingerprints leave the scan only if a bitmap of the benchmark's lets them pass. The bitmap has a fixed
largest size (16 MB) whatever the benchmark's; what it lets through is joined exactly.

Words are told apart by 64-bit hashes. Null texts have no words; rows are judged one by one, whatever their doc_id.
Items with a null item_id make words hit but aren't counted or named. Either table may be empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexarbor.llm import common
from lexarbor.llm.kernels import U64, grams, mix, pieces, sliding_min, window_starts, words

WINDOW, K = 13, 8
#: The bitmap's bits: at most 2^27, 16 MB.
MOST_BITS = 27


def winnowed(g: np.ndarray, first: np.ndarray, window: int, k: int) -> np.ndarray:
    """Positions of k-grams that are the first smallest of some run of `window` words of a row."""
    at = window_starts(first, window)
    w = window - k + 1
    if not len(at):
        return at
    low = sliding_min(g, w)[at]
    picked, open_ = np.zeros(len(g), bool), np.ones(len(at), bool)
    for i in range(w):
        now = open_ & (g[at + i] == low)
        picked[at[now] + i] = True
        open_ &= ~now
    return np.flatnonzero(picked)


def _short_key(g: np.ndarray) -> np.ndarray:
    return mix(g ^ U64(0xA5A5A5A5))


def _slices(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    size = end - start
    offsets = np.r_[0, np.cumsum(size)]
    flat = h[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer((offsets * 8).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())


def _fingerprints(h, first, window, k, short, whole_items):
    """key, position, words before it in the slice, slice start and end, words that a hit needs; ordered by position."""
    row_of = lambda p: np.searchsorted(first, p, side="right") - 1
    g = grams(h, k)
    at = winnowed(g, first, window, k)
    row, reach = row_of(at), window - k
    parts = [(g[at], at, np.maximum(first[row], at - reach), np.minimum(first[row + 1], at + k + reach), np.full(len(at), window))]
    n_words = np.diff(first)
    for n in short:
        at = first[:-1][n_words == n] if whole_items else window_starts(first, n)
        if len(at):
            parts.append((_short_key(grams(h, n)[at]), at, at, at + n, np.full(len(at), n)))
    key, at, start, end, need = (np.concatenate([p[i] for p in parts]) for i in range(5))
    return key, at, start, end, need, row_of(at)


def item_side(window: int, k: int):
    """(item_id, text) to (item_id, key, need, before, slice)."""

    def run(batches):
        for batch in batches:
            for row, data, rows in pieces(batch.column(1)):
                h, _, _, first = words(data, rows)
                key, at, start, end, need, r = _fingerprints(h, first, window, k, range(1, window), True)
                ids = batch.column(0).slice(row, len(rows) - 1).take(pa.array(r))
                yield pa.RecordBatch.from_arrays([ids, pa.array(key.view(np.int64)), pa.array(need.astype(np.int32)), pa.array((at - start).astype(np.int32)), _slices(h, start, end)], names=["item_id", "key", "need", "before", "slice"])

    return run


def document_side(window: int, k: int, short: list[int], bits: int, bitmap):
    """(row, who, text) to (row, who, n_words, hits), hits being the fingerprints that the bitmap lets pass."""
    struct = pa.struct([("key", pa.int64()), ("pos", pa.int32()), ("before", pa.int32()), ("slice", pa.binary())])

    def run(batches):
        passes = bitmap.value
        for batch in batches:
            for row, data, rows in pieces(batch.column(2)):
                h, _, _, first = words(data, rows)
                key, at, start, end, _, r = _fingerprints(h, first, window, k, short, False)
                ok = np.flatnonzero(common.probe(passes, key, bits))
                ok = ok[np.argsort(r[ok], kind="stable")]
                key, at, start, end, r = key[ok], at[ok], start[ok], end[ok], r[ok]
                found = pa.StructArray.from_arrays([pa.array(key.view(np.int64)), pa.array((at - first[r]).astype(np.int32)), pa.array((at - start).astype(np.int32)), _slices(h, start, end)], fields=list(struct))
                hits = pa.ListArray.from_arrays(pa.array(np.searchsorted(r, np.arange(len(rows))).astype(np.int32)), found)
                n = len(rows) - 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), batch.column(1).slice(row, n), pa.array(np.diff(first).astype(np.int64)), hits], names=["row", "who", "n_words", "hits"])

    return run


def extender(k: int):
    """Joined fingerprints (row, pos, before, mine, passage, need, b2, theirs) to (row, start, end, passage): the run of equal words around each, where it is as long as a window."""

    def run(batches):
        for batch in batches:
            row, pos, before, need, b2 = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1, 2, 5, 6))
            (mine, at), (theirs, from_) = (_words_of(batch.column(i)) for i in (3, 7))
            left, right = np.minimum(before, b2), np.minimum(np.diff(at) - before, np.diff(from_) - b2)
            # the words of both sides, laid over each other so that the fingerprints' first words meet
            size = left + right
            offset = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size + left, size)
            same = mine[np.repeat(at[:-1] + before, size) + offset] == theirs[np.repeat(from_[:-1] + b2, size) + offset]
            # the run of equal words around the fingerprint: from the last difference before it to the first one after
            which, differ = np.repeat(np.arange(len(row)), size)[~same], offset[~same]
            low, high = -left, right.copy()
            np.maximum.at(low, which[differ < 0], differ[differ < 0] + 1)
            np.minimum.at(high, which[differ >= 0], differ[differ >= 0])
            ok = np.flatnonzero((high >= np.minimum(k, need)) & (high - low >= need))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ok)), pa.array((pos + low)[ok].astype(np.int32)), pa.array((pos + high)[ok].astype(np.int32)), batch.column(4).take(pa.array(ok))], names=["row", "start", "end", "passage"])

    return run


def _words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes in a column of slices, and where each row's begin."""
    raw = column.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    return np.frombuffer(raw.buffers()[2].slice(int(offsets[0]), int(offsets[-1] - offsets[0])), U64) if len(raw) and offsets[-1] > offsets[0] else np.zeros(0, U64), (offsets - offsets[0]) // 8


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K, share: int = 20, keys: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and share * n_hit >= n_words); with keys also k1 and k2 of common.row_keys.

    Items that have the same words around a fingerprint are one passage: it is extended in a document once, however many items hold it, and the items are
    told once for each passage that a document has.
    """
    spark = docs.sparkSession
    items = common.text_of(benchmark, "item_id").mapInArrow(item_side(window, k), "item_id long, key long, need int, before int, slice binary")
    items = common.saved(items.distinct().withColumn("passage", F.xxhash64("key", "need", "before", "slice")), "items")
    passages = common.saved(items.groupBy("key", "need", "before", "slice").agg(F.min("passage").alias("passage")), "passages")
    n, short = passages.count(), sorted(r.need for r in passages.select("need").distinct().collect() if r.need < window)
    bits = min(MOST_BITS, max(15, (64 * n).bit_length()))
    passes = spark.sparkContext.broadcast(common.bitmap(passages.select("key").distinct(), "key", bits))
    who, texts = (("doc_id", "k1", "k2"), common.row_keys(common.text_of(docs, "doc_id"))) if keys else (("doc_id",), common.text_of(docs, "doc_id"))
    texts = texts.select(F.monotonically_increasing_id().alias("row"), F.struct(*who).alias("who"), "text")
    marked = common.saved(texts.mapInArrow(document_side(window, k, short, bits, passes), f"row long, who struct<{', '.join(f'{c}:long' for c in who)}>, n_words long, hits array<struct<key:long,pos:int,before:int,slice:binary>>"), "marked")
    hits = marked.select("row", F.explode("hits").alias("hit")).select("row", "hit.*")
    both = common.dealt_join(hits, passages.select("key", "need", "passage", F.col("before").alias("b2"), F.col("slice").alias("s2")), "key")
    both = both.select("row", "pos", "before", "slice", "passage", "need", "b2", "s2")
    runs = common.saved(both.mapInArrow(extender(k), "row long, start int, end int, passage long").distinct(), "runs")
    spans = runs.select("row", F.struct("start", "end").alias("span")).distinct().groupBy("row").agg(F.array_sort(F.collect_list("span")).alias("spans"))
    zero = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("reach"))
    joined = F.aggregate(
        "spans", zero, lambda a, s: F.struct((a["hit"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(a["reach"], s["start"].cast("long")))).alias("hit"), F.greatest(a["reach"], s["end"].cast("long")).alias("reach"))
    )
    covered = spans.select("row", joined["hit"].alias("n_hit"))
    met = common.saved(runs.select("row", "passage").distinct(), "met")
    named = common.dealt_join(met, items.select("passage", "item_id").distinct(), "passage").groupBy("row").agg(F.array_sort(F.transform(F.collect_set("item_id"), lambda x: x.cast("string"))).alias("ids"))
    told = marked.select("row", "who", "n_words").join(covered, "row", "left").join(named, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return told.select("who.*", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of docs that aren't contaminated, each judged by its own text, whatever ids it shares."""
    bad = report(docs, benchmark, keys=True, **how).filter("contaminated").select("k1", "k2").distinct()
    return common.without_rows(docs, common.saved(bad, "contaminated"))
