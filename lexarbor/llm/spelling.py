"""Spelling variant grouping by full neighbourhood generation.

Words are maximal runs of the letters A-Z, a-z and U+00C0 to U+00FF, of which only A-Z are lower-cased. Where `misspell` divides the CRC of
`<doc_id>:<run>` (null: no digits), one code point of the run is deleted. The vocabulary holds words of `length` code points and
`least` occurrences or more.

Every word of the vocabulary generates all texts that one deletion, replacement or insertion over the observed alphabet makes of it, each
text once: of a run of equal letters only the last is deleted, and an inserted letter never stands before its equal. These candidates
are hash-joined to the vocabulary; what meets a word is near it, so no distance is computed. A candidate is a 64-bit polynomial hash at
first, got from the word's prefix sums, and only those in a bitmap of the vocabulary's hashes are spelled out and leave their task. The bitmap's
size is fixed (2^30 bits at most, 128 MB); a fuller one lets more candidates through, never fewer.

The alphabet has no more than 90 letters by the definition of words. Every step from a word to its form multiplies the occurrences by `factor` at
least, so paths are short: they are followed by doubling, in a few joins.

Null texts have no words. Every row counts, repeated ones too. An empty table, or one without a word that is frequent enough, gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexarbor.llm import common
from lexarbor.llm.kernels import U64, mix, powers

LETTERS = r"[A-Za-zÀ-ÿ]"
#: Candidates that are hashed at once.
AT_ONCE = 1 << 19
#: The largest bitmap: 128 MB.
MOST_BITS = 30


def vocabulary(docs: DataFrame, length: int = 6, least: int = 5, misspell: int = 199) -> DataFrame:
    """(word, n) of the words of at least `length` code points and `least` occurrences."""
    # a run loses one code point at most, so shorter ones can't count
    runs = docs.select(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(docs["text"].cast("string"), F.lit(f"{LETTERS}{{{length},}}"), F.lit(0))).alias("run"))
    runs = runs.select("id", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("run"))
    runs = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.expr("substring(run, 1, cast(h % length(run) as int))"), F.substr("run", at + 2))
    words = runs.select(F.when(F.col("h") % misspell == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).filter((F.length("word") >= length) & (F.col("n") >= least))


def hashes(words: list[bytes]) -> np.ndarray:
    """The hash of each word of Latin-1 bytes: the sum of (byte + 1) P^position, mixed."""
    flat = np.frombuffer(b"".join(words), np.uint8)
    size = np.array([len(w) for w in words], np.int64)
    begin = np.cumsum(size) - size
    up = powers(int(size.max(initial=0)) + 2)[0]
    position = np.arange(len(flat)) - np.repeat(begin, size)
    total = np.r_[U64(0), np.cumsum((flat.astype(U64) + U64(1)) * up[position], dtype=U64)]
    return mix(total[begin + size] - total[begin])


def hasher(batches):
    """(word, n) to (word, n, h)."""
    for batch in batches:
        h = hashes([w.encode("latin-1") for w in batch.column(0).to_pylist()])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(h.view(np.int64))], names=["word", "n", "h"])


def neighbours(same: np.ndarray, alphabet: np.ndarray, at_once: int = AT_ONCE):
    """For words of one length (rows of code points): parts of their neighbourhoods as (how, word, position, letter, hash).

    how: "d", "r" or "i". Every distinct text comes once; positions are worked on in parts of about at_once candidates.
    """
    count, size = same.shape
    w, letters = same.astype(U64) + U64(1), alphabet.astype(U64) + U64(1)
    up, down = powers(size + 2)
    pre = np.zeros((count, size + 1), U64)
    np.cumsum(w * up[:size], axis=1, out=pre[:, 1:], dtype=U64)
    total = pre[:, -1:]
    step = max(1, at_once // (count * max(1, len(letters))))
    for a in range(0, size + 1, step):
        b = min(size, a + step)
        if a < size:
            here = w[:, a:b]
            after = np.zeros_like(here)
            after[:, : min(size, b + 1) - a - 1] = w[:, a + 1 : min(size, b + 1)]
            row, i = np.nonzero(here != after)
            yield "d", row, i + a, None, mix(pre[row, i + a] + (total[row, 0] - pre[row, i + a + 1]) * down[1])
            row, i, c = np.nonzero(here[:, :, None] != letters)
            yield "r", row, i + a, c, mix(total[row, 0] + (letters[c] - here[row, i]) * up[i + a])
        b = min(size + 1, a + step)
        here = np.zeros((count, b - a), U64)
        here[:, : min(size, b) - a] = w[:, a : min(size, b)]
        row, i, c = np.nonzero(here[:, :, None] != letters)
        yield "i", row, i + a, c, mix(pre[row, i + a] + letters[c] * up[i + a] + (total[row, 0] - pre[row, i + a]) * up[1])


def generator(alphabet: bytes, bitmap, bits: int, at_once: int = AT_ONCE):
    """(word, n) to (word, n, other): the candidates that the bitmap of the vocabulary lets pass, spelled out."""
    letters = np.frombuffer(alphabet, np.uint8)

    def run(batches):
        table = bitmap.value
        for batch in batches:
            words, n = [w.encode("latin-1") for w in batch.column(0).to_pylist()], batch.column(1).to_pylist()
            by_size: dict[int, list[int]] = {}
            for i, w in enumerate(words):
                by_size.setdefault(len(w), []).append(i)
            for size, of in by_size.items():
                step = max(1, at_once // (size * max(1, len(letters))))
                for a in range(0, len(of), step):
                    some, out = of[a : a + step], []
                    same = np.frombuffer(b"".join(words[i] for i in some), np.uint8).reshape(len(some), size)
                    for how, row, at, letter, h in neighbours(same, letters, at_once):
                        for x in np.flatnonzero(common.probe(table, h, bits)):
                            i, p = some[row[x]], int(at[x])
                            w, c = words[i], b"" if letter is None else alphabet[letter[x] : letter[x] + 1]
                            out.append((i, (w[:p] + c + w[p + (how != "i") :]).decode("latin-1")))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array([words[i].decode("latin-1") for i, _ in out]), pa.array([n[i] for i, _ in out], pa.int64()), pa.array([c for _, c in out])], names=["word", "n", "other"])

    return run


def near(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): all pairs of near words of a table (word, n), in both orders."""
    spark = words.sparkSession
    words = common.saved(words.mapInArrow(hasher, "word string, n long, h long"), "vocabulary")
    count = words.count()
    alphabet = "".join(sorted(r[0] for r in words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).filter("c <> ''").distinct().collect()))
    bits = min(MOST_BITS, max(20, (64 * max(1, count)).bit_length()))
    bitmap = spark.sparkContext.broadcast(common.bitmap(words.select("h"), "h", bits))
    # a word stands for a thousand candidates, so a small table is dealt out too
    dealt = words.select("word", "n").repartition(max(spark.sparkContext.defaultParallelism, count // 20_000))
    found = dealt.mapInArrow(generator(alphabet.encode("latin-1"), bitmap, bits), "word string, n long, other string")
    return found.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other").select("word", "n", "other", "other_n")


def followed(forms: DataFrame, rounds: int) -> DataFrame:
    """(word, root) from (word, form), both not null: root is where the forms lead, within 2^rounds steps."""
    reach = common.saved(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(rounds):
        on = reach.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = common.saved(reach.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        reach, more = moved.select("word", "root"), not moved.filter("moved").isEmpty()
        if not more:
            break
    return reach


def variants(docs: DataFrame, length: int = 6, least: int = 5, factor: int = 5, misspell: int = 199) -> DataFrame:
    """One row per word of the vocabulary: word, form, root, n, n_near, form_n.

    form: the near word that is the most frequent one (ties: first in code-point order), if it occurs `factor` times as often or more. root: what forms lead to, word itself without one.
    """
    words = common.saved(vocabulary(docs, length, least, misspell), "words")
    best = near(words).groupBy("word").agg(F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"), F.count("*").alias("n_near"))
    told = words.join(best, "word", "left")
    much = -F.col("best.less") >= factor * F.col("n")
    told = common.saved(told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(much, F.col("best.other")).alias("form"), F.when(much, -F.col("best.less")).alias("form_n")), "forms")
    # a path multiplies n by factor with each step, and n is below 2^63
    steps = int(np.ceil(63 / np.log2(factor)))
    roots = followed(told.filter("form is not null"), steps.bit_length())
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
