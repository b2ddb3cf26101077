"""Language identification by a byte convolutional network, trained and run in numpy.

A text is cut into windows of 256 bytes. Bytes (capital letters made small, digits made 0) are embedded, filters of widths two to
five run over them, each filter's maximum over the window is pooled, and a linear layer with softmax tells the
window's language. A text's prediction is the mean of its windows' probabilities: every byte counts, and short and very
long texts take the same path, in blocks of windows of fixed size.

The languages are all that labelled training documents with text have. Of each, training takes `least` documents, or its share of
`sample` if that is more, those of least hash, and `per_text` windows spread over each; never held-out ones. Languages weigh
by the documents taken, not by how many there are.

Null texts, and texts without a letter, are `und` with score 0. Without labels everything is `und`. A null doc_id
hashes as empty text. Rows are judged one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexarbor.llm import common
from lexarbor.llm.kernels import pieces
from lexarbor.llm.toxicity import held_out

WINDOW, WIDTHS, EMBEDDED, FILTERS, BLOCK = 256, (2, 3, 4, 5), 8, 12, 96
UNKNOWN = "und"


def normal(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the capitals of Latin-1 in UTF-8 made small, digits made 0, control bytes made blanks."""
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 32
    table[0x30:0x3A] = 0x30
    table[:0x20] = 0x20
    out = table[data]
    capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)) + 1
    out[capital] += 0x20
    return out


def cut(data: np.ndarray, rows: np.ndarray, window: int, margin: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows' bytes in windows (0 after the end and in the margin), and the row of each window."""
    length = np.diff(rows)
    count = -(-length // window)
    row = np.repeat(np.arange(len(length)), count)
    first = np.cumsum(count) - count
    at = np.arange(len(data)) - np.repeat(rows[:-1], length)
    out = np.zeros((int(count.sum()), window + margin), np.uint8)
    out[np.repeat(first, length) + at // window, at % window] = normal(data)
    return out, row


class Network:
    """Embedding (256 x d), filters (widest * d x n; rows beyond a filter's width stay 0), dense layer (n x classes)."""

    def __init__(self, classes: int, seed: int):
        rng = np.random.default_rng(seed)
        n, d = FILTERS * len(WIDTHS), EMBEDDED
        self.width = np.repeat(WIDTHS, FILTERS)
        self.open = (np.arange(max(WIDTHS))[:, None] < self.width[None, :]).repeat(d, 0).astype(np.float32)
        self.p = [rng.normal(0, 0.5, (256, d)), rng.normal(0, 1, (max(WIDTHS) * d, n)) / np.sqrt(self.width * d), np.zeros(n), rng.normal(0, 0.1, (n, classes)), np.zeros(classes)]
        self.p = [x.astype(np.float32) for x in self.p]
        self.p[0][0] = 0
        self.p[1] *= self.open

    def pooled(self, windows: np.ndarray, where: bool = False):
        """Maxima of the filters over each window (and where they are)."""
        x = self.p[0][windows]
        n, length, d = x.shape
        taps = max(WIDTHS)
        flat = np.lib.stride_tricks.as_strided(x, (n, length - taps + 1, taps * d), (x.strides[0], x.strides[1], x.strides[2]))
        response = np.ascontiguousarray(flat).reshape(-1, taps * d) @ self.p[1]
        response = response.reshape(n, length - taps + 1, -1)
        if not where:
            return response.max(1) + self.p[2]
        at = response.argmax(1)
        return np.take_along_axis(response, at[:, None, :], 1)[:, 0] + self.p[2], at

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        z = np.maximum(self.pooled(windows), 0) @ self.p[3] + self.p[4]
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def gradients(self, windows: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        top, at = self.pooled(windows, True)
        hidden = np.maximum(top, 0)
        z = hidden @ self.p[3] + self.p[4]
        z = np.exp(z - z.max(1, keepdims=True))
        z /= z.sum(1, keepdims=True)
        z[np.arange(len(y)), y] -= 1
        z /= len(y)
        back = (z @ self.p[3].T) * (top > 0)
        taps, d = max(WIDTHS), EMBEDDED
        seen = windows[np.arange(len(windows))[:, None, None], at[:, :, None] + np.arange(taps)]  # windows x filters x taps
        patch = self.p[0][seen].reshape(len(windows), -1, taps * d)
        filters = np.einsum("wf,wfx->xf", back, patch) * self.open
        into = (back[:, :, None] * self.p[1].T[None]).reshape(-1, d)
        embedding = np.stack([np.bincount(seen.reshape(-1), weights=into[:, i], minlength=256) for i in range(d)], 1)
        embedding[0] = 0
        return [embedding, filters, back.sum(0), hidden.T @ z, z.sum(0)]

    def train(self, windows: np.ndarray, y: np.ndarray, rounds: int, rate: float, batch: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        m, v, step = [np.zeros_like(x) for x in self.p], [np.zeros_like(x) for x in self.p], 0
        for r in range(rounds):
            order = rng.permutation(len(y))
            for i in range(0, len(y), batch):
                step += 1
                for j, g in enumerate(self.gradients(windows[order[i : i + batch]], y[order[i : i + batch]])):
                    m[j] = 0.9 * m[j] + 0.1 * g
                    v[j] = 0.99 * v[j] + 0.01 * g * g
                    self.p[j] = (self.p[j] - rate * (1 - r / rounds) * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            self.p[1] *= self.open


def windower(per_text: int):
    """(lang, text) to (lang, window): windows spread over each text."""

    def run(batches):
        for batch in batches:
            for row, data, rows in pieces(batch.column(1)):
                windows, of = cut(data, rows, WINDOW, max(WIDTHS) - 1)
                first = np.searchsorted(of, np.arange(len(rows)))
                picked = [np.unique(np.linspace(a, b - 1, min(per_text, b - a)).astype(int)) for a, b in zip(first[:-1], first[1:], strict=True) if b > a]
                picked = np.concatenate(picked) if picked else np.zeros(0, int)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(rows) - 1).take(pa.array(of[picked])), pa.array([w.tobytes() for w in windows[picked]], pa.binary())], names=["lang", "window"])

    return run


def _has_letter(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    letter = ((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A)
    count = np.r_[0, np.cumsum(letter)]
    found = count[rows[1:]] > count[rows[:-1]]
    beyond = np.r_[0, np.cumsum(data >= 0x80)]
    for i in np.flatnonzero(~found & (beyond[rows[1:]] > beyond[rows[:-1]])):
        found[i] = any(c.isalpha() for c in data[rows[i] : rows[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


def predictor(network: Network, classes: list[str]):
    """(doc_id, held_out, text) to (doc_id, held_out, lang_pred, score)."""

    def run(batches):
        for batch in batches:
            for row, data, rows in pieces(batch.column(2)):
                n = len(rows) - 1
                windows, of = cut(data, rows, WINDOW, max(WIDTHS) - 1)
                # a window counts by the letters' bytes it holds
                weight = ((windows >= 0x61) & (windows <= 0x7A) | (windows >= 0x80)).sum(1)
                total = np.zeros((n, len(classes)))
                for i in range(0, len(windows), BLOCK):
                    p = network.probabilities(windows[i : i + BLOCK]) * weight[i : i + BLOCK, None]
                    np.add.at(total, of[i : i + BLOCK], p)
                sums = total.sum(1)
                known = _has_letter(data, rows) & (sums > 0)
                best = total.argmax(1)
                score = np.where(known, total[np.arange(n), best] / np.maximum(sums, 1e-12), 0.0)
                names = pa.array([classes[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), batch.column(1).slice(row, n), names, pa.array(np.clip(score, 0, 1))], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def least_of_each(known: DataFrame, n: int) -> DataFrame:
    """(lang, doc_id) of the n documents of least hash of each language. Only those under a bound that about 2 n + 100 of a
    language pass are ordered."""
    ids = known.select("lang", "doc_id").distinct().withColumn("_h", F.xxhash64("doc_id"))
    counts = common.saved(ids.groupBy("lang").agg(F.count("*").alias("_n")), "languages")
    some = ids.join(F.broadcast(counts), "lang").filter((F.col("_n") <= 2 * n + 100) | (F.col("_h") / 2.0**64 + 0.5 < (2 * n + 100) / F.col("_n")))  # a row a language
    return some.withColumn("_r", F.row_number().over(W.partitionBy("lang").orderBy("_h", "doc_id"))).filter(F.col("_r") <= n).select("lang", "doc_id")


def train(docs: DataFrame, folds: int, fold: int, sample: int, least: int, per_text: int, rounds: int, seed: int) -> tuple[Network | None, list[str]]:
    known = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("lang"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.col("text") != "") & ~held_out(F.col("doc_id"), folds, fold))
    n = max(least, sample // max(1, known.select("lang").distinct().count()))
    chosen = common.saved(least_of_each(known, n), "chosen")
    # the sample's ids, a bounded number a language, go to the texts, which may be long and stay where they are
    windows = known.join(F.broadcast(chosen), ["lang", "doc_id"]).select(F.struct("lang", "doc_id").alias("who"), "text").mapInArrow(windower(per_text), "lang struct<lang:string,doc_id:long>, window binary").select("lang.*", "window")
    ranked = windows.withColumn("_r", F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "window"))).filter(F.col("_r") <= n * per_text)
    table = ranked.select("doc_id", "lang", "window").orderBy("doc_id", "lang", "window").select("lang", "window").toArrow()
    names = table.column("lang").to_pylist()
    classes = sorted(set(names))
    if not classes:
        return None, []
    x = np.frombuffer(b"".join(table.column("window").to_pylist()), np.uint8).reshape(len(names), -1)
    network = Network(len(classes), seed)
    network.train(x, np.searchsorted(classes, names), rounds, 0.01, 64, seed)
    return network, classes


def predict(docs: DataFrame, folds: int = 4, fold: int = 2, sample: int = 1500, per_text: int = 3, rounds: int = 8, seed: int = 11, least: int = 200) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    network, classes = train(docs, folds, fold, sample, least, per_text, rounds, seed)
    texts = common.text_of(docs, "doc_id").select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "text")
    if network is None:
        return texts.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return texts.mapInArrow(predictor(network, classes), "doc_id long, held_out boolean, lang_pred string, score double")
