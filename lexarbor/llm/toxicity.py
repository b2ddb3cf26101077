"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, trained from document labels.

A sentence ends at `.`, `!`, `?` or a line feed. Its score is the logistic of a bias and a weight for each word and for each
word's first bytes (hashed features). The bias's own share is taken off: a sentence offends with p = (s(b + z) - s(b)) / (1 - s(b)), s
being the logistic function and z the sum of its weights, or with 0 where that is negative, so that thousands of plain sentences
don't add up. A document is toxic unless all its sentences are clean, and by a small chance (the leak) without any: 1 - (1 - leak) prod(1 - p).
Only documents are labelled; the likelihood of their labels under this very combination trains the weights, and so finds out which
sentences offend.

Training takes at most `sample` clean documents and a third as many toxic ones, those of least hash, never held-out ones, one text for each
doc_id (of repeated rows the first by code points), and weighs them by how many their label has; the weights are a table of fixed size. Of a
document of more than `most` sentences so many are learned from, spread evenly from its first to its last, which bounds the sample's memory
whatever the lengths; no document is left out. Scoring reads every text whole.

Null and empty texts have no sentence and score the leak, as all documents without any sign do. Rows with null or conflicting labels: null is no label, the highest
label of a doc_id counts. Without any labels every score is 0. A null doc_id hashes as empty text, and is held out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexarbor.llm import common
from lexarbor.llm.kernels import pieces, word_features

BITS, PREFIXES = 18, (3, 4, 5, 6)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def instances(data: np.ndarray, rows: np.ndarray, bits: int, prefixes: tuple[int, ...]):
    """Features of the words, the number of the sentence of each word, and row, first and last byte of the sentences."""
    features, starts, ends, first = word_features(data, rows, prefixes, bits)
    stops = np.flatnonzero((data == 0x2E) | (data == 0x21) | (data == 0x3F) | (data == 0x0A))
    mark = np.searchsorted(stops, starts)  # stops before the word
    row = np.searchsorted(first, np.arange(len(starts)), side="right") - 1
    new = np.ones(len(starts), bool)
    new[1:] = (mark[1:] != mark[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    last = np.r_[at[1:], len(starts)] - 1
    return features, np.cumsum(new) - 1, row[at], starts[at] if len(at) else at, ends[last] if len(at) else at


def spread(n: np.ndarray, most: int) -> np.ndarray:
    """For rows of n sentences which of these are among at most `most` of their row, spread evenly over it."""
    local = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    size = np.repeat(np.maximum(n, most), n)
    return (local + 1) * most // size > local * most // size


def featurizer(bits: int, prefixes: tuple[int, ...], useful: np.ndarray, most: int):
    """(label, text) to (label, n, sentence, feature): the number of sentences, `most` at most, and the useful features in them."""

    def run(batches):
        for batch in batches:
            for row, data, rows in pieces(batch.column(1)):
                features, sentence, of, _, _ = instances(data, rows, bits, prefixes)
                chosen = spread(np.bincount(of, minlength=len(rows) - 1), most)
                features, sentence, of = features[chosen[sentence]], (np.cumsum(chosen) - 1)[sentence[chosen[sentence]]], of[chosen]
                first = np.searchsorted(of, np.arange(len(rows)))
                flat, number = features.reshape(-1), np.repeat(sentence, features.shape[1])
                kept = useful[flat]
                flat, number = flat[kept], number[kept]
                offsets = pa.array(np.searchsorted(number, first).astype(np.int32))
                local = (number - first[of[number]]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (local, flat)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(rows) - 1), pa.array(np.diff(first).astype(np.int32)), *lists], names=["label", "n", "sentence", "feature"])

    return run


FEATURES = "label int, n int, sentence array<int>, feature array<int>"


def useful_features(documents: DataFrame, bits: int, prefixes: tuple[int, ...], most: int) -> np.ndarray:
    """Which of the 2^bits features (and none, at the end) three documents have, and toxic ones oftener or rarer than by chance."""
    size = 1 << bits
    every = np.ones(size + 1, bool)
    every[size] = False
    told = documents.mapInArrow(featurizer(bits, prefixes, every, most), FEATURES).select("label", F.explode(F.array_distinct("feature")).alias("feature"))
    counts = told.groupBy("feature").agg(F.count("*").alias("seen"), F.sum("label").alias("toxic")).filter("seen >= 3").toArrow()
    base = documents.agg(F.avg("label")).first()[0] or 0.0
    at, seen, toxic = (counts.column(c).to_numpy().astype(np.int64) for c in ("feature", "seen", "toxic"))
    z = (toxic - seen * base) / np.sqrt(np.maximum(seen * base * (1 - base), 1e-9))
    out = np.zeros(size + 1, bool)
    out[at[np.abs(z) > 2]] = True
    return out


def fit(table: pa.Table, share: float, bits: int, rounds: int = 150, rate: float = 0.3, decay: float = 2e-3) -> tuple[np.ndarray, float, float]:
    """Weights (with a 0 for no feature at the end), bias and leak that make the documents' labels likely.

    share: of all labelled documents, how many are toxic; the sample may have more.
    """
    size = 1 << bits
    weights = np.zeros(size + 1)
    labels = table.column("label").to_numpy().astype(np.float64)
    if not len(labels) or labels.min() == labels.max():
        return weights, 0.0, (0.0 if not len(labels) or labels[0] == 0 else 1.0)
    n = table.column("n").to_numpy().astype(np.int64)
    local, feature = (table.column(c).combine_chunks() for c in ("sentence", "feature"))
    doc = np.repeat(np.arange(len(labels)), np.diff(local.offsets.to_numpy()))
    sentence, feature = (np.cumsum(n) - n)[doc] + local.flatten().to_numpy(), feature.flatten().to_numpy()
    of = np.repeat(np.arange(len(labels)), n)
    base = labels.mean()
    weight = np.where(labels == 1, share / base, (1 - share) / (1 - base))
    bias = np.log(share / (1 - share)) - np.log(max(1.0, len(of) / len(labels)))
    leak = np.log(share / 10)  # of the hazard
    m, v = np.zeros(size + 3), np.zeros(size + 3)
    for step in range(1, rounds + 1):
        z = np.bincount(sentence, weights=weights[feature], minlength=len(of))
        p, calm = (1 / (1 + np.exp(-np.clip(x, -30, 30))) for x in (bias + z, bias))
        active = z >= 0
        # hazards, -log(1 - p), add up
        hazard = np.where(active, np.logaddexp(0, bias + z) - np.logaddexp(0, bias), 0)
        total = np.exp(leak) + np.bincount(of, weights=hazard, minlength=len(labels))
        clean = np.exp(-total)
        slope = np.where(labels == 1, -clean / np.maximum(1 - clean, 1e-3), 1.0) * weight
        down = slope[of] * active
        g = np.r_[np.bincount(feature, weights=(down * p)[sentence], minlength=size + 1), (down * (p - calm)).sum(), slope.sum() * np.exp(leak)] / len(labels)
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        weights -= move[:-2]
        weights = np.sign(weights) * np.maximum(np.abs(weights) - rate * decay, 0)  # few features stay
        bias -= 0.3 * move[-2]
        leak = min(np.log(0.2), leak - 0.3 * move[-1])
    weights[size] = 0
    return weights, float(bias), float(1 - np.exp(-np.exp(leak)))


def scorer(weights, bias: float, leak: float, bits: int, prefixes: tuple[int, ...], threshold: float):
    """(who, held_out, text) to (who, held_out, score, sentences): the sentences that offend, in code points."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())])

    def run(batches):
        table, calm = weights.value, 1 / (1 + np.exp(-bias))
        for batch in batches:
            for row, data, rows in pieces(batch.column(2)):
                features, sentence, of, start, end = instances(data, rows, bits, prefixes)
                z = np.bincount(sentence, weights=table[features].sum(1), minlength=len(of))
                p = 1 / (1 + np.exp(-np.clip(bias + z, -30, 30)))
                p = np.maximum(0, (p - calm) / (1 - calm))
                score = 1 - (1 - leak) * np.exp(np.bincount(of, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(rows) - 1))
                bad = np.flatnonzero(p >= threshold)
                points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
                base = points[rows[of[bad]]]
                found = pa.StructArray.from_arrays([pa.array(points[start[bad]] - base), pa.array(points[end[bad]] - base), pa.array(p[bad])], fields=list(span))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of[bad], np.arange(len(rows))).astype(np.int32)), found)
                n = len(rows) - 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), batch.column(1).slice(row, n), pa.array(np.clip(score, 0, 1)), lists], names=["who", "held_out", "score", "sentences"])

    return run


def score(docs: DataFrame, labels: DataFrame, column: str = "toxic", folds: int = 5, fold: int = 0, sample: int = 3000, most: int = 2000, bits: int = BITS, prefixes: tuple[int, ...] = PREFIXES, keys: bool = False) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, n_offending, sentences (array of start, end, p); with keys also k1 and k2 of common.row_keys."""
    texts = common.text_of(docs, "doc_id")
    told = labels.select(labels["doc_id"].cast("long").alias("doc_id"), (labels[column].cast("int") > 0).cast("int").alias("label")).dropna().groupBy("doc_id").agg(F.max("label").alias("label"))
    # ids are chosen first: of the texts only the sample's, one for each id, are moved
    known = common.saved(texts.select("doc_id").join(told.filter(~held_out(F.col("doc_id"), folds, fold)), "doc_id").distinct(), "known")
    least = [common.least_hashed(known.filter(F.col("label") == label), n) for label, n in ((0, sample), (1, max(1, sample // 3)))]
    chosen = common.saved(least[0].unionByName(least[1]), "chosen")
    picked = common.saved(texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("label", "text"), "picked")
    total = told.filter(~held_out(F.col("doc_id"), folds, fold)).agg(F.avg(F.col("label").cast("double"))).first()[0]
    useful = useful_features(picked, bits, prefixes, most)
    weights, bias, leak = fit(picked.mapInArrow(featurizer(bits, prefixes, useful, most), FEATURES).toArrow(), min(max(total or 0.0, 1e-3), 1 - 1e-3), bits)
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    who, named = (("doc_id", "k1", "k2"), common.row_keys(texts)) if keys else (("doc_id",), texts)
    scored = named.select(F.struct(*who).alias("who"), held_out(F.col("doc_id"), folds, fold).alias("held_out"), "text")
    scored = scored.mapInArrow(scorer(shared, bias, leak, bits, prefixes, 0.5), f"who struct<{', '.join(f'{c}:long' for c in who)}>, held_out boolean, score double, sentences array<struct<start:long,end:long,p:double>>")
    return scored.select("who.*", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("sentences").cast("long").alias("n_offending"), "sentences")


def reject(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of docs that aren't predicted toxic, each judged by its own text, whatever ids it shares."""
    bad = score(docs, labels, keys=True, **how).filter("predicted = 1").select("k1", "k2").distinct()
    return common.without_rows(docs, common.saved(bad, "toxic"))
