"""Token losses of a masked model that is counted, not trained: each word is told from both its neighbours.

p(w | l, r) follows Witten and Bell: the counts of w between l and r, mixed with the mean of what l alone and r alone tell, each
of these mixed with the words' own counts, where an unseen word has a share of one. The weight of what is mixed in is the number of different words seen in
that context.

Tasks count the words they read, and hand the counts on by bucket of their hash, sorted and packed. Asked texts are kept in chunks: a chunk asks each bucket
for its different keys, in order, and is answered in that order, so neither places nor keys come back. Triples, pairs and single words are one shuffle each, one after
the other, and a shuffle's files go when its answers are kept. A word is 64 bits of hash; between the same neighbours 48 bits tell words apart.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexarbor.functions import text as tx
from lexarbor.operators import dedup

#: Words of a text that are scored if nothing else is said, as many as the models that this stands for take.
MOST = 128
#: Words that are counted together, and of a chunk; characters of a bucket.
TOGETHER, CHUNK, BUCKET_CHARS = 1 << 21, 1 << 19, 22

U64 = np.uint64
TRIPLE, PAIR, SINGLE, TEXTS, PART, TOTAL = range(6)
PACKED = "chunk long, kind int, bucket int, n int, packed binary"


def _hashed(text: str, most: int | None) -> Column:
    words = tx.tokens(F.coalesce(F.col(text), F.lit("")))
    words = F.slice(words, 1, most) if most else words
    return F.transform(words, lambda w: F.xxhash64(w))


def between(docs: DataFrame, keys: list[str], text: str = "text", most: int | None = None) -> DataFrame:
    """(keys, l, w, r) of each word and its neighbours, 64 bits of hash each; an empty string stands beyond either end."""
    end = F.array(F.xxhash64(F.lit("")))

    def around(w: Column) -> Column:
        n = F.size(w) - 2
        return F.arrays_zip(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), F.slice(w, F.lit(3), n)).cast("array<struct<l:long,w:long,r:long>>")

    told = tx.let(F.concat(end, _hashed(text, most), end), around)
    # the outer form, since Spark would compute the list once more to leave out empty ones
    return docs.select(*keys, F.explode_outer(told).alias("t")).filter("t is not null").select(*keys, "t.*")


def fit(docs: DataFrame, text: str = "text") -> DataFrame:
    """(text): the texts whose words losses() counts."""
    return docs.select(F.col(text).alias("text"))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U64(29))) * U64(0x9E3779B97F4A7C15)
    return h ^ (h >> U64(32))


def _both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mix(_mix(a) * U64(0xC2B2AE3D27D4EB4F) + b)


def _pack(columns: list[np.ndarray]) -> bytes:
    """The columns' bytes by their place in a number, compressed; of the first one, which is sorted, the steps."""
    first = columns[0].view(U64)
    held = [np.r_[first[:1], np.diff(first)], *columns[1:]]
    return pa.compress(b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8).T).tobytes() for c in held), "zstd", asbytes=True)


def _unpack(packed: bytes, n: int, width: int) -> list[np.ndarray]:
    raw = np.frombuffer(pa.decompress(packed, 8 * n * width, "zstd"), np.uint8).reshape(width, 8, n)
    first, *rest = (np.ascontiguousarray(c.T).view(U64).ravel() for c in raw)
    return [np.cumsum(first, dtype=U64), *rest]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    """A batch of (chunk, kind, bucket, n, packed)."""
    types = pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["chunk", "kind", "bucket", "n", "packed"])


def _dealt(chunk: int, kind: int, bucket: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """A row for each run of equal buckets."""
    heads = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)])
    return _rows([(chunk, kind, int(bucket[a]), int(b - a), _pack([c[a:b] for c in columns])) for a, b in zip(heads, np.r_[heads[1:], len(bucket)], strict=True)])


def _distinct(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(different rows, in order; number of the one that each row is)."""
    order = np.lexsort(columns[::-1])
    held = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in held])
    at = np.empty(len(order), np.int64)
    at[order] = np.cumsum(new) - 1
    return [c[new] for c in held], at


def _summed(at: np.ndarray, n: int, values: np.ndarray) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, at, values.view(np.int64))
    return out.view(U64)


class Counts:
    """What the tasks do; end is the hash that stands beyond a text's ends, bits are those of a bucket's number, together and size as TOGETHER and CHUNK."""

    def __init__(self, end: int, bits: int):
        self.end, self.bits, self.together, self.size = U64(end & 0xFFFFFFFFFFFFFFFF), bits, TOGETHER, CHUNK

    def bucket(self, h: np.ndarray) -> np.ndarray:
        return (h >> U64(64 - self.bits)).astype(np.int32)

    def padded(self, words: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words with an end before, between and after the texts, places of the words); n: words of each text."""
        n = n[n > 0]
        at = np.arange(len(words)) + np.repeat(np.arange(len(n)), n) + 1
        out = np.full(len(words) + len(n) + 1, self.end)
        out[at] = words
        return out, at

    def triples(self, every: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _both(every[at - 1], every[at + 1]), every[at] >> U64(16)

    def counter(self, kind: int):
        """(words) to counts by bucket: of triples by their neighbours, or of pairs."""

        def told(held):
            keys, at = _distinct(*(np.concatenate(c) for c in zip(*held, strict=True)))
            bucket = self.bucket(keys[0] if kind == TRIPLE else _both(*keys))
            n = np.bincount(at, minlength=len(keys[0])).astype(U64)
            if kind == PAIR:
                order = np.argsort(bucket, kind="stable")
                keys, n, bucket = [c[order] for c in keys], n[order], bucket[order]
            return _dealt(-1, kind, bucket, [*keys, n])

        def run(batches):
            held, size = [], 0
            for batch in batches:
                column = batch.column(0)
                every, at = self.padded(column.flatten().to_numpy(zero_copy_only=False).view(U64), np.diff(column.offsets.to_numpy()))
                if kind == PAIR:
                    at = np.arange(len(every) - 1) if len(at) else at
                for a in range(0, len(at), self.together):
                    now = at[a : a + self.together]
                    held.append(self.triples(every, now) if kind == TRIPLE else (every[now], every[now + 1]))
                    size += len(now)
                    if size >= self.together:
                        yield told(held)
                        held, size = [], 0
            if size:
                yield told(held)

        return run

    def chunker(self):
        """(key, words) to (chunk, kind, bucket, n, packed, keys, sizes): texts with words together, about CHUNK words each."""

        def run(batches):
            keys, sizes, words, size, number = [], [], [], 0, TaskContext.get().partitionId() << 32

            def told():
                raw = np.concatenate(words)
                row = _rows([(number, TEXTS, 0, len(raw), pa.compress(raw.tobytes(), "zstd", asbytes=True))])
                lists = pa.ListArray.from_arrays(pa.array([0, sum(map(len, keys))], pa.int32()), pa.concat_arrays(keys)), pa.array([np.concatenate(sizes)], pa.list_(pa.int32()))
                return pa.RecordBatch.from_arrays([*row.columns, *lists], names=[*row.schema.names, "keys", "sizes"])

            for batch in batches:
                key, column = batch.columns
                offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
                n = np.diff(offsets)
                a = 0
                while a < len(n):
                    b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + self.size - size, side="right")) - 1)
                    some = np.flatnonzero(n[a:b])
                    keys.append(key.slice(a, b - a).take(pa.array(some)))
                    sizes.append(n[a:b][some].astype(np.int32))
                    words.append(flat[offsets[a] : offsets[b]].copy())
                    size += int(offsets[b] - offsets[a])
                    if size >= self.size or (b < len(n) and size):
                        yield told()
                        keys, sizes, words, size, number = [], [], [], 0, number + 1
                    a = b
            if size:
                yield told()

        return run

    def texts(self, row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words with ends, places of the words, words of each text) of a chunk."""
        words, n = np.frombuffer(pa.decompress(row["packed"], 8 * row["n"], "zstd"), U64), np.array(row["sizes"], np.int64)
        return *self.padded(words, n), n

    def keys(self, kind: int, every: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """A chunk's different keys, in order, and the number of each place's key: of a word's triple, of a word and what follows, of a word."""
        of = self.triples(every, at) if kind == TRIPLE else (_both(every[:-1], every[1:]),) if kind == PAIR else (every,)
        return _distinct(*of)

    def asker(self, kind: int):
        """Chunks to their different keys by bucket."""

        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.select(["chunk", "n", "packed", "sizes"]).slice(i, 1).to_pylist()[0]
                    every, at, _ = self.texts(row)
                    keys, _ = self.keys(kind, every, at)
                    yield _dealt(row["chunk"], kind, self.bucket(keys[0]), keys)

        return run

    def answerer(self, kind: int):
        """Counts (of chunk -1) and keys of each bucket, counts first, to the answers; of pairs also what they say of single words (PART), of these the sums (TOTAL)."""
        wide = {TRIPLE: 3, PAIR: 3, SINGLE: 6}[kind]

        def table(held):
            """The counts of a bucket: sorted keys, and what they answer."""
            columns = [np.concatenate(c) for c in zip(*held, strict=True)] if held else [np.zeros(0, U64)] * wide
            if kind == SINGLE:
                (key,), at = _distinct(columns[0])
                return [key], [_summed(at, len(key), c) for c in columns[1:]]
            keys, at = _distinct(*columns[:2])
            n = _summed(at, len(keys[0]), columns[2])
            if kind == PAIR:
                return keys, [n]
            (of,), group = _distinct(keys[0])
            h = _both(*keys)
            order = np.argsort(h)
            return [of, h[order]], [n[order], _summed(group, len(of), n), np.bincount(group, minlength=len(of)).astype(U64)]

        def find(key, values, asked):
            if not len(key):
                return [np.zeros(len(asked), U64) for _ in values]
            at = np.minimum(np.searchsorted(key, asked), len(key) - 1)
            return [np.where(key[at] == asked, v[at], U64(0)) for v in values]

        def answered(keys, values, asked):
            if kind == TRIPLE:
                return find(keys[1], values[:1], _both(*asked)) + find(keys[0], values[1:], asked[0])
            return find(keys[0], values, asked[0])

        def run(batches):
            now, held, ready, parts, size, total = None, [], None, [], 0, np.zeros(2, np.int64)

            def settled():
                """The bucket's table; adds what it says of single words, or the sums."""
                nonlocal size, total
                keys, values = table(held)
                if kind == PAIR and len(keys[0]):
                    (a, b), (n,) = keys, values
                    one, none = np.ones(len(n), U64), np.zeros(len(n), U64)
                    left, right = (b != self.end), (a != self.end)
                    # of each word: (n, t) as a left neighbour, as a right one, and how often it occurs
                    both = [[a, np.where(left, n, none), np.where(left, one, none), none, none, none], [b, none, none, np.where(right, n, none), np.where(right, one, none), np.where(left, n, none)]]
                    parts.append(combined([[np.concatenate(c) for c in zip(*both, strict=True)]]))
                    size += len(parts[-1][0])
                elif kind == SINGLE:
                    total += [int(values[4].sum()), int(np.count_nonzero(values[4]))]
                if kind == PAIR:
                    h = _both(*keys)
                    order = np.argsort(h)
                    return [h[order]], [values[0][order]]
                return keys, values

            def combined(parts):
                columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
                (word,), at = _distinct(columns[0])
                return [word, *(_summed(at, len(word), c) for c in columns[1:])]

            def told():
                every = combined(parts)
                return _dealt(-1, PART, self.bucket(every[0]), every)

            for batch in batches:
                for row in batch.to_pylist():
                    if row["bucket"] != now:
                        if now is not None and ready is None:
                            settled()
                        now, held, ready = row["bucket"], [], None
                    if row["chunk"] < 0:
                        held.append(_unpack(row["packed"], row["n"], wide))
                        continue
                    ready = settled() if ready is None else ready
                    held = []
                    found = answered(*ready, _unpack(row["packed"], row["n"], 2 if kind == TRIPLE else 1))
                    yield _rows([(row["chunk"], kind, now, row["n"], _pack([np.zeros(row["n"], U64), *found]))])
                    if size > self.together:
                        yield told()
                        parts, size = [], 0
            if now is not None and ready is None:
                settled()
            if parts:
                yield told()
            if kind == SINGLE:
                yield _rows([(-1, TOTAL, 0, 1, total.tobytes())])

        return run

    def scorer(self, key: str, total: int, words: int):
        """Answers and texts of each chunk, texts last, to (key, loss, n): the sum of a text's losses and its words."""
        width = {TRIPLE: 3, PAIR: 1, SINGLE: 5}
        share = lambda c, n, t, low: np.where(n > 0, (c + t * low) / np.maximum(n + t, 1), low)

        def run(batches):
            answers = {k: [] for k in width}
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.select(["kind", "n", "packed", "sizes"]).slice(i, 1).to_pylist()[0]
                    if row["kind"] != TEXTS:
                        answers[row["kind"]].append(_unpack(row["packed"], row["n"], width[row["kind"]] + 1)[1:])
                        continue
                    every, at, n = self.texts(row)
                    got = {}
                    for kind, held in answers.items():
                        _, of = self.keys(kind, every, at)
                        got[kind] = [np.concatenate(c).astype(np.float64)[of] for c in zip(*held, strict=True)]
                    (c3, n3, t3), (pair,), (nl, tl, nr, tr, c0) = got[TRIPLE], got[PAIR], got[SINGLE]
                    p0 = (c0[at] + 1) / (total + words + 1)
                    p1 = (share(pair[at - 1], nl[at - 1], tl[at - 1], p0) + share(pair[at], nr[at + 1], tr[at + 1], p0)) / 2
                    loss = np.add.reduceat(-np.log(share(c3, n3, t3, p1)), np.r_[0, np.cumsum(n)[:-1]])
                    yield pa.RecordBatch.from_arrays([batch.column("keys").slice(i, 1).flatten(), pa.array(loss), pa.array(n)], names=[key, "loss", "n"])
                    answers = {k: [] for k in width}

        return run


@contextmanager
def _shuffles_removed(spark):
    """Shuffle files of what runs meanwhile go when it is done."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def losses(model: DataFrame, docs: DataFrame, key: str, text: str = "text", most: int | None = MOST) -> DataFrame:
    """(key, loss, n_tokens): the mean negative log-probability of a text's words (the first `most`, or with None all), and how many they are; texts without words are left out."""
    spark = docs.sparkSession
    dedup.ensure_checkpoints(spark)
    first = model.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).select("chars", F.xxhash64(F.lit("")).alias("end")).first()
    counts = Counts(first.end, max(6, (first.chars >> BUCKET_CHARS).bit_length()))
    held = T.StructType([*T._parse_datatype_string(PACKED).fields, T.StructField("keys", T.ArrayType(docs.schema[key].dataType)), T.StructField("sizes", T.ArrayType(T.IntegerType()))])
    with _shuffles_removed(spark):
        chunks = docs.select(key, _hashed(text, most).alias("words")).mapInArrow(counts.chunker(), held).checkpoint()

        def answers(kind: int, told: DataFrame) -> DataFrame:
            both = told.unionByName(chunks.mapInArrow(counts.asker(kind), PACKED))
            return both.repartition("bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(counts.answerer(kind), PACKED).checkpoint()

        words = model.select(_hashed("text", None).alias("words"))
        triples, pairs = (answers(kind, words.mapInArrow(counts.counter(kind), PACKED)) for kind in (TRIPLE, PAIR))
        singles = answers(SINGLE, pairs.filter(F.col("kind") == PART))
    sums = [np.frombuffer(r.packed, np.int64) for r in singles.filter(F.col("kind") == TOTAL).select("packed").collect()]  # a row a task
    total, different = (int(x) for x in np.sum(sums, 0)) if sums else (0, 0)
    every = triples.unionByName(pairs).unionByName(singles).filter("chunk >= 0").unionByName(chunks, allowMissingColumns=True)
    scored = T.StructType([docs.schema[key], T.StructField("loss", T.DoubleType()), T.StructField("n", T.LongType())])
    scored = every.repartition("chunk").sortWithinPartitions("chunk", "kind", "bucket").mapInArrow(counts.scorer(key, total, different), scored)
    return scored.groupBy(key).agg((F.sum("loss") / F.sum("n")).alias("loss"), F.sum("n").alias("n_tokens"))
