"""Substring dedup by collinear chaining: fuzzy passages that documents share.

Seeds are word 4-grams: those whose hash ends in `sample_bits` zero bits and, where `window` 4-grams in a row have none, the one of
smallest hash. What is a seed depends on the words around it alone, so equal words have equal seeds. Which seeds two documents hold is
counted first, with a few bytes a seed; only these leave the scan again. A seed's key is its hash and, from the second occurrence in a
document on, its number there (repetitive texts then match along a diagonal).

1. Each key's first document, by row, is its pivot, and other occurrences are matched with the pivot's: as many matches as
   occurrences, however many documents share a passage. A seed carries two bits of each of the 64 words around it, by which
   matches of a chance seed are told from those of a passage; these are kept besides where three matches of two documents follow
   each other. Where the words around a seed and its pivot's don't all but agree, all earlier holders are looked at, too, by the
   task that holds the key's seeds or, of keys that several tasks hold, in cells: the earliest one around which more agree, and the one of most.
2. The pivot of a common seed may hold nothing else of a passage. So where no passage has been found yet, each seed and the next one
   that others hold (odd words between them are straddled) are a key with a pivot of its own, for which every holder counts.
3. Equal runs of `min_words` are found without exception: wherever no passage has been found yet and no seed of a run of `min_words`
   words is the document's own (held by no other, or by no earlier one), the hash of the whole run is a key. Every holder counts.

The matches of a document and a pivot are chained: the best chain that ends at a match is the best one to its left and
below, less a cost for the gap, which a Fenwick tree of prefix maxima finds. Chains break at wide gaps. Then the words are
aligned between the matches of a chain and beyond its ends, and a passage is a stretch of them that has `min_words` words on
either side and `similarity` of them agree: the whole alignment, or else the longest such stretches of it.

So results are complete for equal runs; a fuzzy passage is missed where it has no seed, or none of its seeds and pairs of seeds has a
pivot or a close holder that holds it. A document's own repetitions aren't passages that it shares. Null texts have no words. Documents are rows,
whatever their doc_id; a null doc_id is given out as null. Words are told apart by 32 bits of their hash. An empty table, or one of
short texts, gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexarbor.llm import common
from lexarbor.llm.kernels import U64, grams, mix, pieces, powers, window_starts, words

K, SAMPLE_BITS, WINDOW, MIN_WORDS, SIMILARITY = 4, 2, 24, 50, 0.8
#: Words: the widest gap inside a chain, the most that its sides may drift apart there, and what is read beyond its ends.
MAX_GAP, MAX_DRIFT, MARGIN = 40, 20, 96
#: Words that are worked on together; seeds that are sorted together, in a task and in a bucket of the count.
PIECE_WORDS, TASK_SEEDS, BUCKET_SEEDS = 1 << 18, 1 << 22, 1 << 22
#: Words before a seed that its context holds (of 64 in all), and how many of the 64 agree where a passage goes on.
BEFORE, AGREE = 30, 28
#: The words of 64 that must agree with another holder than the first, and fewer than which must agree with the first one's; pairs that are compared at a time; seeds on a cell's side, of keys that several tasks hold.
CLOSE, ASK, PAIRS, CELL = 32, 48, 1 << 18, 1 << 14
#: Words of a text that uncovered() tells apart from others by a filter.
CHUNK = 32
#: Words that are moved together to where chains are aligned.
BLOCK = 64
#: The largest bitmap of seeds: 2^29 bits, 64 MB.
MOST_BITS = 29


def hasher():
    """(row, doc_id, text) to (row, doc_id, words, n): 32-bit word hashes as bytes, and how many."""

    def run(batches):
        for batch in batches:
            for row, data, rows in pieces(batch.column(2)):
                h, _, _, first = words(data, rows)
                n, small = len(rows) - 1, (h >> U64(32)).astype(np.uint32)
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer((first * 4).astype(np.int64)), pa.py_buffer(small)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), batch.column(1).slice(row, n), raw, pa.array(np.diff(first).astype(np.int32))], names=["row", "doc_id", "words", "n"])

    return run


def runs_of_words(batch: pa.RecordBatch):
    """(first row in the batch, words, number of the first word of each row) for rows of about PIECE_WORDS words; column 1 holds the words."""
    column = batch.column(1).cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] // 4
    every = np.frombuffer(column.buffers()[2], np.uint32) if column.buffers()[2] is not None else np.zeros(0, np.uint32)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE_WORDS, side="right")) - 1)
        yield row, every[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def seeds(small: np.ndarray, first: np.ndarray, k: int, sample_bits: int, window: int):
    """Positions, rows and hashes of the seeds, and their keys."""
    g = grams(mix(small.astype(U64)), k)
    at = window_starts(first, k)
    value = g[at]
    picked = np.zeros(len(g), bool)
    picked[at[(value & U64((1 << sample_bits) - 1)) == 0]] = True
    wide = window_starts(first, k + window - 1)
    if len(wide):
        upto = np.r_[0, np.cumsum(picked)]
        bare = wide[upto[wide + window] == upto[wide]]
        if len(bare):
            picked[bare + g[bare[:, None] + np.arange(window)].argmin(1)] = True
    pos = np.flatnonzero(picked)
    of, value = np.searchsorted(first, pos, side="right") - 1, g[pos]
    # the number of each occurrence in its document
    order = np.lexsort((value, of))
    new = np.ones(len(order), bool)
    new[1:] = (value[order][1:] != value[order][:-1]) | (of[order][1:] != of[order][:-1])
    heads = np.flatnonzero(new)
    number = np.zeros(len(order), U64)
    number[order] = np.arange(len(order)) - np.repeat(heads, np.diff(np.r_[heads, len(order)]))
    return pos, of, value, np.where(number == 0, value, mix(value + number * U64(0xC2B2AE3D27D4EB4F)))


def counter(how: tuple, buckets: int):
    """(row, words) to (bucket, keys): the distinct keys of many rows, twice if two rows hold them; 32 bits of each, as bytes."""
    shift = buckets.bit_length() - 1

    def pack(held):
        keys = np.sort(np.concatenate(held))
        new = np.r_[True, keys[1:] != keys[:-1]]
        twice = np.r_[False, ~new[1:] & new[:-1]]
        keys = keys[new | twice]
        bucket = (keys >> U64(64 - shift)).astype(np.int64) if shift else np.zeros(len(keys), np.int64)
        low = ((keys << U64(shift)) >> U64(32)).astype(np.uint32)
        names, starts = np.unique(bucket, return_index=True)
        ends = np.r_[starts[1:], len(keys)]
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array([low[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary())], names=["bucket", "keys"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for _, small, first in runs_of_words(batch):
                held.append(seeds(small, first, *how)[3])
                n += len(held[-1])
                if n >= TASK_SEEDS:
                    yield pack(held)
                    held, n = [], 0
        if n:
            yield pack(held)

    return run


def repeated(buckets: int):
    """(bucket, keys), a bucket's rows together, to the (key) that were there twice: the key's first bits, in place of all 64."""

    def tell(bucket, held):
        keys = np.sort(np.concatenate(held))
        same = keys[1:] == keys[:-1]
        found = np.unique(keys[1:][same]).astype(np.int64) | (np.int64(bucket) << 32)
        return pa.RecordBatch.from_arrays([pa.array(found)], names=["key"])

    def run(batches):
        held, now = [], None
        for batch in batches:
            for bucket, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket != now and held:
                    yield tell(now, held)
                    held = []
                now = bucket
                held.append(np.frombuffer(raw.as_buffer(), np.uint32))
        if held:
            yield tell(now, held)

    return run


def short_key(key: np.ndarray, buckets: int) -> np.ndarray:
    """The bits of a key that repeated() tells."""
    return key >> U64(32 - (buckets.bit_length() - 1))


def contexts(small: np.ndarray, first: np.ndarray, pos: np.ndarray, of: np.ndarray) -> list[np.ndarray]:
    """Two bits of each of the 64 words around the positions, in two longs; beyond a text's ends 0."""
    symbol = ((small >> np.uint32(5)) & np.uint32(3)).astype(U64)
    out = []
    for begin in (-BEFORE, 32 - BEFORE):
        total = np.zeros(len(pos), U64)
        for j in range(32):
            at = pos + begin + j
            inside = (at >= first[of]) & (at < first[of + 1])
            total |= np.where(inside, symbol[np.where(inside, at, 0)], U64(0)) << U64(2 * j)
        out.append(total)
    return out


def seeder(how: tuple, buckets: int, bits: int, passes):
    """(row, words) to (row, key, pos, pair, c1, c2) of the seeds that the bitmap lets pass; pair: the key of it and the next one."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for row, small, first in runs_of_words(batch):
                pos, of, value, key = seeds(small, first, *how)
                ok = np.flatnonzero(common.probe(passes.value, short_key(key, buckets), bits))
                pos, of, value, key = pos[ok], of[ok], value[ok], key[ok]
                pair, near = np.zeros(len(pos), U64), np.zeros(len(pos), bool)
                near[:-1] = (of[1:] == of[:-1]) & (np.diff(pos) <= MAX_GAP)
                pair[:-1] = mix(value[:-1] * U64(0x9FB21C651E98DF25) + value[1:])
                flat = [key.view(np.int64), (pos - first[of]).astype(np.int32)]
                c1, c2 = contexts(small, first, pos, of)
                yield pa.RecordBatch.from_arrays([pa.array(ids[row + of]), *map(pa.array, flat), pa.array(pair.view(np.int64), mask=~near), pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64))], names=["row", "key", "pos", "pair", "c1", "c2"])

    return run


def agreeing_words(c1, c2, i, j):
    """How many of the 64 words around agree, of seeds i and j."""
    odd = [(c[i] ^ c[j]).view(U64) for c in (c1, c2)]
    return 64 - sum(np.bitwise_count((o | (o >> U64(1))) & U64(0x5555555555555555)).astype(np.int32) for o in odd)


def closest(row, c1, c2, low, i, least):
    """(seed, other, words that agree): of seeds i, each with all others from low to i - 1, the earliest and the closest one of at least `least`."""
    n = i - low
    low, i, least, n = low[n > 0], i[n > 0], least[n > 0], n[n > 0]
    upto, found = np.r_[0, np.cumsum(n)], []
    a = 0
    while a < len(i):
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + PAIRS, side="right")) - 1)
        of = np.repeat(i[a:b], n[a:b])
        other = np.arange(upto[b] - upto[a]) - np.repeat(upto[a:b] - upto[a] - low[a:b], n[a:b])
        agree = agreeing_words(c1, c2, of, other)
        ok = np.flatnonzero(agree >= np.repeat(least[a:b], n[a:b]))
        ok = ok[row[of[ok]] != row[other[ok]]]
        if len(ok):
            of, other, agree = of[ok], other[ok], agree[ok]
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            order = np.lexsort((other, -agree, of))
            took = np.unique(np.r_[first, order[first]])
            found.append((of[took], other[took], agree[took]))
        a = b
    return [np.concatenate(c) for c in zip(*found, strict=True)] if found else None


def cells():
    """(cell, key, row, pos, c1, c2, least) sorted by cell, key, row, pos to (key, row, pivot, pos, at, agree): as closest(), of seeds that have a `least` with the others in the cell."""

    def told(held):
        key, row, pos, c1, c2, least = (np.concatenate(c) for c in zip(*held, strict=True))
        at = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], np.arange(len(key)), 0))
        i = np.flatnonzero(least > 0)
        # a seed may be there twice, as one that asks and as one that is asked: a row's own don't count
        found = closest(row, c1, c2, at[i], i, least[i])
        if found:
            of, other, agree = found
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (key[of], row[of], row[other], pos[of], pos[other], agree)], names=["key", "row", "pivot", "pos", "at", "agree"])

    def run(batches):
        held, now = [], None
        for batch in batches:
            cell, *rest = (c.to_numpy() for c in batch.columns)
            cuts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]][: len(cell)])
            for a, b in zip(cuts, np.r_[cuts[1:], len(cell)], strict=True):
                if held and cell[a] != now:
                    yield from told(held)
                    held = []
                now = cell[a]
                held.append([c[a:b].copy() for c in rest])
        if held:
            yield from told(held)

    return run


def matcher():
    """Seeds sorted by (key, row, pos) to (kind, key, row, pivot, pos, at, agree, pair, c1, c2).

    Kind 0: a match with the key's first seed. Kind 3: where fewer than ASK words around agree with the first one's, matches with the earliest seed of the key
    around which more do, CLOSE at least, and with the one of most. A partition's first key may have begun in an earlier one:
    its seeds are given out as they are (kind 1), and so are the seeds of the last key (kind 2), which may go on.
    """
    names = ["kind", "key", "row", "pivot", "pos", "at", "agree", "pair", "c1", "c2"]

    def told(kind, n, batch=None, kept=None, **known):
        none = lambda t: pa.nulls(n, t)
        types = dict(zip(names, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))
        read = {} if batch is None else {c: batch.column(c).take(pa.array(kept)) for c in batch.schema.names if kind == 1 or c in ("row", "pos") or (c == "pair" and not kind)}
        flat = read | {c: pa.array(v) for c, v in known.items()} | {"kind": pa.array(np.full(n, kind, np.int32))}
        return pa.RecordBatch.from_arrays([flat[c].cast(types[c]) if c in flat else none(types[c]) for c in names], names=names)

    def run(batches):
        head, now, held = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, *rest = (batch.column(c).to_numpy() for c in ("key", "row", "pos", "c1", "c2"))
            head = key[0] if head is None else head
            # the last batch's last key may go on: its first seeds come before this one's
            n = len(held[0]) if held is not None and key[0] == now else 0
            row, pos, c1, c2 = every = [np.concatenate(c) for c in zip(held, rest, strict=True)] if n else rest
            keys = np.concatenate([np.full(n, now), key]) if n else key
            at = np.maximum.accumulate(np.where(np.r_[True, keys[1:] != keys[:-1]], np.arange(len(keys)), 0))
            i = np.arange(n, len(keys))
            low, opened, differ = at[n:], key == head, row[n:] != row[at[n:]]
            if opened.any():
                yield told(1, int(opened.sum()), batch, np.flatnonzero(opened))
            agree = agreeing_words(c1, c2, i, low)
            kept = np.flatnonzero(~opened & differ)
            yield told(0, len(kept), batch, kept, pivot=row[low[kept]], at=pos[low[kept]], agree=agree[kept])
            # an opened key's first seed is elsewhere: its seeds meet in cells
            asking = np.flatnonzero(differ & ~opened & (agree < ASK))
            others = closest(row, c1, c2, low[asking] + 1, i[asking], np.maximum(CLOSE, agree[asking] + 1))
            if others:
                of, other, same = others
                yield told(3, len(of), batch, of - n, pivot=row[other], at=pos[other], agree=same)
            # of an opened key no seed is held against another here
            now, held = key[-1], [c[at[-1] :][: 1 if key[-1] == head else None].copy() for c in every]
        if now is not None and now != head:
            yield told(2, len(held[0]), key=np.full(len(held[0]), now), **dict(zip(("row", "pos", "c1", "c2"), held, strict=True)))

    return run


def chain(x: np.ndarray, y: np.ndarray, n: np.ndarray, cost: float, max_gap: int, max_drift: int) -> list[list[int]]:
    """Collinear chains of the matches of n words (x ascending), best first, none in two; cut where a gap is wide."""
    values = np.unique(y)
    rank = (np.searchsorted(values, y) + 1).tolist()
    xs, ys, ns, m = x.tolist(), y.tolist(), n.tolist(), len(values)
    best, holder = [float("-inf")] * (m + 1), [-1] * (m + 1)
    score, before = [0.0] * len(xs), [-1] * len(xs)
    i = 0
    while i < len(xs):
        end = i
        while end < len(xs) and xs[end] == xs[i]:
            top, who, r = float("-inf"), -1, rank[end] - 1
            while r:
                if best[r] > top:
                    top, who = best[r], holder[r]
                r &= r - 1
            gain = top - cost * (xs[end] + ys[end])
            score[end], before[end] = (ns[end] + gain, who) if gain > 0 else (ns[end], -1)
            end += 1
        for j in range(i, end):  # matches at one place don't follow each other
            value, r = score[j] + cost * (xs[j] + ys[j]), rank[j]
            while r <= m:
                if value > best[r]:
                    best[r], holder[r] = value, j
                r += r & -r
        i = end
    used, out = [False] * len(xs), []
    for j in sorted(range(len(xs)), key=lambda j: -score[j]):
        run = []
        while j >= 0 and not used[j]:
            used[j] = True
            if run:
                dx, dy = xs[run[-1]] - xs[j], ys[run[-1]] - ys[j]
                if max(dx, dy) - ns[j] > max_gap or abs(dx - dy) > max_drift:
                    out.append(run[::-1])
                    run = []
            run.append(j)
            j = before[j]
        if run:
            out.append(run[::-1])
    return out


def chainer(k: int):
    """(row, pivot, pos, at, agree) sorted to (row, pivot, x0, x1, y0, y1, xs, ys, ns): chains of diagonal runs.

    Matches whose words around agree too little count only where three of the two documents follow each other. Matches on one
    diagonal, MAX_GAP / 2 words apart at most, are a run.
    """

    def together(row, pivot, x, y):
        """Which matches are one of three of two documents within 1.5 MAX_GAP words and the drift allowed."""
        ok = np.zeros(len(x), bool)
        if len(x) > 2:
            three = (row[2:] == row[:-2]) & (pivot[2:] == pivot[:-2]) & (x[2:] - x[:-2] <= 3 * MAX_GAP // 2)
            for i in (1, 2):
                three &= np.abs((x[i : len(x) - 2 + i] - y[i : len(x) - 2 + i]) - (x[:-2] - y[:-2])) <= MAX_DRIFT
            for i in range(3):
                ok[i : len(x) - 2 + i] |= three
        return ok

    def groups(row, pivot, x, y, agree):
        kept = np.flatnonzero((agree >= AGREE) | together(row, pivot, x, y))
        row, pivot, x, y = row[kept], pivot[kept], x[kept], y[kept]
        if not len(row):
            return []
        order = np.lexsort((x, x - y, pivot, row))
        r, p, u, d = row[order], pivot[order], x[order], (x - y)[order]
        new = np.r_[True, (r[1:] != r[:-1]) | (p[1:] != p[:-1]) | (d[1:] != d[:-1]) | (np.diff(u) > MAX_GAP // 2)]
        heads = np.flatnonzero(new)
        tails = np.r_[heads[1:], len(r)] - 1
        r, p, u, d, n = r[heads], p[heads], u[heads], d[heads], u[tails] + k - u[heads]
        order = np.lexsort((u - d, u, p, r))
        r, p, u, v, n = r[order], p[order], u[order], (u - d)[order], n[order]
        heads = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (p[1:] != p[:-1])])
        out = []
        for a, b in zip(heads, np.r_[heads[1:], len(r)], strict=True):
            for c in [[0]] if b - a == 1 else chain(u[a:b], v[a:b], n[a:b], 0.05, MAX_GAP, MAX_DRIFT):
                xs, ys, ns = u[a:b][c], v[a:b][c], n[a:b][c]
                out.append((r[a], p[a], xs[0], (xs + ns).max(), ys[0], (ys + ns).max(), xs, ys, ns))
        return out

    def batch(out):
        flat = [pa.array(np.array([o[i] for o in out], np.int64)) for i in range(6)]
        return pa.RecordBatch.from_arrays(flat + [pa.array([o[i].astype(np.int32) for o in out], pa.list_(pa.int32())) for i in (6, 7, 8)], names=["row", "pivot", "x0", "x1", "y0", "y1", "xs", "ys", "ns"])

    def run(batches):
        held = None
        for b in batches:
            columns = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns]
            if not len(columns[0]):
                continue
            if held is not None:
                columns = [np.concatenate(c) for c in zip(held, columns, strict=True)]
            row, pivot = columns[:2]
            # the last pair of documents may go on in the next batch
            last = int(np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (pivot[1:] != pivot[:-1])])[-1])
            held = [c[last:] for c in columns]
            if out := groups(*(c[:last] for c in columns)):
                yield batch(out)
        if held is not None and (out := groups(*held)):
            yield batch(out)

    return run


def equal_words(a: np.ndarray, b: np.ndarray) -> int:
    """The length of the longest common subsequence of two short runs of words."""
    if not len(a) or not len(b):
        return 0
    row = np.zeros(len(b) + 1, np.int64)
    for word in a:
        row[1:] = np.maximum(row[1:], np.where(b == word, row[:-1] + 1, 0))
        np.maximum.accumulate(row, out=row)
    return int(row[-1])


#: Odd words that extend() passes by on either side, fewest first.
STEPS = [step for d in range(1, 5) for step in [(d, d), *((d, e) for e in range(d - 1, -1, -1)), *((e, d) for e in range(d - 1, -1, -1))]]


def extend(a: np.ndarray, b: np.ndarray, agree: int = 3) -> list[tuple[int, int, int]]:
    """Where two runs agree from their begin: (word of a, word of b, words that agree). Goes on after a few odd
    words on either side if `agree` words agree there."""
    i = j = 0
    out, a_raw, b_raw = [], a.tobytes(), b.tobytes()
    size = agree * a.itemsize
    while True:
        n = min(len(a) - i, len(b) - j)
        differ = a[i : i + n] != b[j : j + n]
        run = int(differ.argmax()) if n else 0
        run = n if n and not differ[run] else run
        if run:
            out.append((i, j, run))
        i, j = i + run, j + run
        for di, dj in STEPS:
            if i + di + agree <= len(a) and j + dj + agree <= len(b):
                u, v = (i + di) * a.itemsize, (j + dj) * a.itemsize
                if a_raw[u : u + size] == b_raw[v : v + size]:
                    break
        else:
            return out
        i, j = i + di, j + dj


def stretches(blocks: list[tuple[int, int, int]], between: list[int], min_words: int, similarity: float, sides: tuple[int, int] | None = None) -> list[tuple[int, int, int, int, int]]:
    """The stretches (start, end, other start, other end, words that agree) of an alignment that are passages: all of it, or
    else the longest, and those on either side of it.

    blocks: (x, y, words that agree) in order; between: words that agree after each block, before the next. sides: the lengths of both
    texts, where a stretch that is too short may take odd words beyond its ends if enough of min_words words agree.
    """
    if sum(b[2] for b in blocks) + sum(between) < similarity * min_words:
        return []
    x, y, n = (np.array(c, np.int64) for c in zip(*blocks, strict=True))
    before = np.r_[0, np.cumsum(n + np.array(between, np.int64))]
    out, todo = [], [(0, len(n))]
    while todo:
        low, high = todo.pop()
        best = None
        for i in range(low, high):
            if best and x[high - 1] + n[high - 1] - x[i] <= best[0]:
                break
            ends = np.arange(high - 1, i - 1, -1)
            dx, dy = x[ends] + n[ends] - x[i], y[ends] + n[ends] - y[i]
            same = before[ends] + n[ends] - before[i]
            odd = np.maximum(0, min_words - np.minimum(dx, dy))
            room = min(x[i], y[i]) + np.minimum(sides[0] - x[ends] - n[ends], sides[1] - y[ends] - n[ends]) if sides else 0
            good = np.flatnonzero((odd <= room) & (same >= similarity * (np.maximum(dx, dy) + odd)))
            if len(good) and (best is None or dx[good[0]] > best[0]):
                best = (dx[good[0]], i, int(ends[good[0]]), int(same[good[0]]), int(odd[good[0]]))
        if best:
            _, i, j, same, odd = best
            left = max(0, odd - int(min(sides[0] - x[j] - n[j], sides[1] - y[j] - n[j]))) if odd else 0
            out.append((int(x[i]) - left, int(x[j] + n[j]) + odd - left, int(y[i]) - left, int(y[j] + n[j]) + odd - left, same))
            todo += [(low, i), (j + 1, high)]
    return out


def agreeing(a: np.ndarray, b: np.ndarray, x: int, y: int, n: int) -> list[tuple[int, int, int]]:
    """The runs of equal words (x, y, length) along a diagonal."""
    same = np.r_[False, a[x : x + n] == b[y : y + n], False]
    edges = np.flatnonzero(same[1:] != same[:-1])
    return [(x + u, y + u, v - u) for u, v in edges.reshape(-1, 2).tolist()]


def aligner(min_words: int, similarity: float):
    """Chains with the words around them to (row, pivot, start, end, other_start, other_end, n_equal)."""

    def align(a, ax, b, by, xs, ys, ns, agree, sides=None):
        x, y = xs[0] - ax, ys[0] - by
        blocks = [(x - i - n, y - j - n, n) for i, j, n in reversed(extend(a[:x][::-1], b[:y][::-1], agree))]
        between = [0] * len(blocks)
        i, j = x, y
        for u, v, n in zip(xs, ys, ns, strict=True):
            u, v = u - ax, v - by
            shift = max(0, i - u, j - v)
            if shift >= n:
                continue
            u, v, n = u + shift, v + shift, n - shift
            if blocks:
                between[-1] = equal_words(a[i:u], b[j:v])
            runs = agreeing(a, b, u, v, n)
            blocks += runs
            between += [0] * len(runs)
            i, j = u + n, v + n
        right = [(i + p, j + q, n) for p, q, n in extend(a[i:], b[j:], agree)]
        blocks, between = blocks + right, between + [0] * len(right)
        return [(s + ax, e + ax, t + by, f + by, same) for s, e, t, f, same in stretches(blocks, between, min_words, similarity, sides)]

    def run(batches):
        for batch in batches:
            out = []
            for row, pivot, ax, a, by, b, xs, ys, ns in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
                how = a, ax, b, by, xs, ys, ns
                # ends that only single words reach, or odd ones, count where there is no passage without them
                out += [(row, pivot, *found) for found in align(*how, 3) or align(*how, 1) or align(*how, 1, (len(a), len(b)))]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(7)], names=["row", "pivot", "start", "end", "other_start", "other_end", "n_equal"])

    return run


def run_keys(small: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n words in a row; rows not heeded."""
    if len(small) < n:
        return np.zeros(0, U64)
    up, down = powers(len(small) + 1)
    total = np.r_[U64(0), np.cumsum(mix(small.astype(U64)) * up[: len(small)], dtype=U64)]
    return mix((total[n:] - total[:-n]) * down[: len(total) - n])


def unclaimed(how: tuple, buckets: int, bits: int, passes, min_words: int):
    """(row, words) to (row, low, high): runs of min_words words begin at low to high - 1 that hold no seed that only this row has."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for row, small, first in runs_of_words(batch):
                pos, of, value, _ = seeds(small, first, *how)
                alone = np.flatnonzero(~common.probe(passes.value, short_key(value, buckets), bits))
                # a run between two such seeds may hold all but one word of each
                place, owner = np.r_[pos[alone], first[1:]], np.r_[of[alone], np.arange(len(first) - 1)]
                ends = place + how[0] - 1
                ends[len(alone) :] = first[1:]
                begins = np.r_[place[: len(alone)] + 1, first[:-1]]
                owner_b = np.r_[of[alone], np.arange(len(first) - 1)]
                order_e, order_b = np.lexsort((ends, owner)), np.lexsort((begins, owner_b))
                low, end, who = begins[order_b], ends[order_e], owner[order_e]
                ok = np.flatnonzero(end - low >= min_words)
                base = first[who[ok]]
                yield pa.RecordBatch.from_arrays([pa.array(ids[row + who[ok]]), pa.array((low[ok] - base).astype(np.int32)), pa.array((end[ok] - base - min_words + 1).astype(np.int32))], names=["row", "low", "high"])

    return run


def asker(how: tuple, min_words: int):
    """(row, words, gaps, spans, own) to (row, key, pos): the runs in the gaps that no span holds and that hold no own seed.

    A seed is the row's own if the row is the first that holds it; of later occurrences in a row that isn't said.
    """

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                small = np.frombuffer(batch.column(1)[i].as_buffer(), np.uint32)
                open_ = np.zeros(max(0, len(small) - min_words + 1) + 1, np.int64)
                for g in batch.column(2)[i].as_py():
                    open_[g["low"]] += 1
                    open_[g["high"]] -= 1
                open_ = np.cumsum(open_)[:-1] > 0
                for s in batch.column(3)[i].as_py() or ():
                    open_[s["start"] : max(s["start"], s["end"] - min_words + 1)] = False
                own = batch.column(4)[i].as_py()
                if own and open_.any():
                    pos, _, value, key = seeds(small, np.array([0, len(small)]), *how)
                    for at in np.intersect1d(pos[value == key], own):
                        open_[max(0, at + how[0] - min_words) : at + 1] = False
                at = np.flatnonzero(open_)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), batch.column(0)[i].as_py(), np.int64)), pa.array(run_keys(small, min_words)[at].view(np.int64)), pa.array(at.astype(np.int32))], names=["row", "key", "pos"])

    return run


def holder(min_words: int, bits: int, asked):
    """(row, words) to (row, key, pos) of the runs of min_words words that the bitmap lets pass, the first of each in a row."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for row, small, first in runs_of_words(batch):
                at = window_starts(first, min_words)
                key = run_keys(small, min_words)[at] if len(at) else np.zeros(0, U64)
                ok = np.flatnonzero(common.probe(asked.value, key, bits))
                of = np.searchsorted(first, at[ok], side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(ids[row + of]), pa.array(key[ok].view(np.int64)), pa.array((at[ok] - first[of]).astype(np.int32))], names=["row", "key", "pos"])

    return run


def block_keys(row: np.ndarray, block: np.ndarray) -> np.ndarray:
    return mix(mix(row.astype(np.int64).view(U64)) + block.astype(U64))


def block_asker():
    """(row, low, high) to (key): the blocks of words that low to high - 1 lie in."""

    def run(batches):
        for batch in batches:
            row, low, high = (c.to_numpy() for c in batch.columns)
            first = low // BLOCK
            n = (high - 1) // BLOCK - first + 1
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(block_keys(np.repeat(row, n), np.repeat(first, n) + at)).view(np.int64))], names=["key"])

    return run


def trimmer(bits: int, asked):
    """(row, words) to (row, blocks, words): the numbers of the blocks that the bitmap lets pass, and their words in one."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for row, small, first in runs_of_words(batch):
                n = -(-np.diff(first) // BLOCK)
                of = np.repeat(np.arange(len(n)), n)
                block = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                ok = np.flatnonzero(common.probe(asked.value, block_keys(ids[row + of], block), bits))
                of, block = of[ok], block[ok]
                begin = first[of] + block * BLOCK
                size = np.minimum(begin + BLOCK, first[of + 1]) - begin
                upto, heads = np.r_[0, np.cumsum(size)], np.flatnonzero(np.r_[True, of[1:] != of[:-1]][: len(of)])
                kept = small[np.repeat(begin - upto[:-1], size) + np.arange(upto[-1])]
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(heads), [None, pa.py_buffer((np.r_[upto[heads], upto[-1]] * 4).astype(np.int64)), pa.py_buffer(kept)]).cast(pa.binary())
                blocks = pa.ListArray.from_arrays(pa.array(np.r_[heads, len(of)].astype(np.int32)), pa.array(block.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[row + of[heads]]), blocks, raw], names=["row", "blocks", "words"])

    return run


def _bits(n: int) -> int:
    return min(MOST_BITS, max(16, (16 * max(1, n)).bit_length()))


def uncovered(seeds_: DataFrame, spans: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """The rows of seeds_ (row, pos and others) that no span (row, spans: start, end) holds; those in CHUNK words that no span touches meet no join.

    lengths (row, n: words), if it has all rows: nor do those in CHUNK words that one span holds. A filter of all other chunks tells them; where it is
    full, more rows meet the join, and none is lost.
    """
    chunk = lambda c: F.floor(F.col(c) / CHUNK)
    touched = spans.select("row", F.explode("spans").alias("s")).select("row", F.explode(F.sequence(chunk("s.start"), F.floor((F.col("s.end") - 1) / CHUNK))).alias("chunk"))
    split = common.IdFilter(common.saved(touched.select(F.xxhash64("row", "chunk").alias("_k")).distinct(), "touched"), "_k").split(seeds_, F.xxhash64(F.col("row"), chunk("pos")))
    near = split.filter("_maybe").drop("_maybe")
    if lengths is not None:
        n = lengths.agg(F.sum(F.ceil(F.col("n") / CHUNK))).first()[0] or 0
        rest = lengths.filter("n > 0").join(spans, "row", "left").select("row", "spans", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK))).alias("chunk"))
        rest = rest.filter(f"spans is null or not exists(spans, s -> s.start <= chunk * {CHUNK} and (chunk + 1) * {CHUNK} <= s.end)").select(F.xxhash64("row", "chunk").alias("_k"))
        near = common.IdFilter(rest, "_k", n).split(near, F.xxhash64(F.col("row"), chunk("pos"))).filter("_maybe").drop("_maybe")
    held = near.join(spans, "row", "left").filter("spans is null or not exists(spans, s -> s.start <= pos and pos < s.end)").drop("spans")
    return split.filter("not _maybe").drop("_maybe").unionByName(held.select(*seeds_.columns))


def shared(docs: DataFrame, k: int = K, sample_bits: int = SAMPLE_BITS, window: int = WINDOW, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row per passage that a document shares with the first one that holds it.

    doc_id, start_word, end_word (exclusive), other_id, other_start, other_end, n_equal, similarity.
    """
    spark, how = docs.sparkSession, (k, sample_bits, window)
    send = spark.sparkContext.broadcast
    texts = common.text_of(docs, "doc_id").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    table = texts.mapInArrow(hasher(), "row long, doc_id long, words binary, n int")
    path = common.scratch_path(spark, "words")
    table.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(table.schema).parquet(path)
    held = table.select("row", "words")

    # which seeds two documents hold
    total = table.agg(F.sum(F.length("words")).alias("n")).first().n or 0
    buckets = 1 << max(6, (total // (4 << sample_bits) // BUCKET_SEEDS).bit_length())
    counted = held.mapInArrow(counter(how, buckets), "bucket long, keys binary").repartition("bucket").sortWithinPartitions("bucket")
    twice = common.saved(counted.mapInArrow(repeated(buckets), "key long"), "repeated")
    bits = _bits(twice.count())
    passes = send(common.bitmap(twice, "key", bits))
    common.dropped(twice)

    # seeds with the first document that holds them
    met = common.saved(held.mapInArrow(seeder(how, buckets, bits, passes), "row long, key long, pos int, pair long, c1 long, c2 long"), "met")
    matched, others = _matches(met)
    found = common.saved(_aligned(matched.drop("pair").unionByName(others), held, k, min_words, similarity), "first")

    # pairs of seeds, where no passage holds them yet
    spans = found.groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    asked = uncovered(matched.filter("pair is not null").select("row", "pos", F.col("pair").alias("key")), spans, table.select("row", "n"))
    asked = common.saved(asked, "asked")
    pairs = common.maybe(met.filter("pair is not null").select(F.col("pair").alias("key"), "row", "pos"), asked.select("key"), "key")
    pairs = pairs.groupBy("key").agg(F.min(F.struct("row", "pos")).alias("p"), F.max("row").alias("top"), F.count("*").alias("n")).filter("p.row <> top").drop("top")
    pairs = common.saved(pairs, "pairs")
    second = common.lookup(asked, pairs, "key").filter("row <> p.row").select("row", F.col("p.row").alias("pivot"), "pos", F.col("p.pos").alias("at"), F.lit(64).alias("agree"))
    # whom a document was matched with for this place already is no news
    second = common.saved(second.withColumn("_k", F.xxhash64("row", "pivot", "pos", "at")), "asked-pairs")
    known = common.maybe(matched.select("row", "pivot", "pos", "at").withColumn("_k", F.xxhash64("row", "pivot", "pos", "at")), second.select("_k"))
    second = second.join(known, ["row", "pivot", "pos", "at", "_k"], "left_anti").drop("_k")
    more = common.saved(_aligned(second, held, k, min_words, similarity), "second")
    found = found.unionByName(more).distinct()
    common.dropped(asked, pairs, met)

    # equal runs of min_words, where no passage holds them yet
    gaps = common.saved(held.mapInArrow(unclaimed(how, buckets, bits, passes, min_words), "row long, low int, high int"), "gaps")
    spans = found.groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    gaps = gaps.join(spans, "row", "left").filter(f"spans is null or not exists(spans, s -> s.start <= low and high + {min_words - 1} <= s.end)")
    gaps = common.saved(gaps.groupBy("row").agg(F.collect_list(F.struct("low", "high")).alias("gaps"), F.first("spans").alias("spans")), "open")
    own = common.maybe(matched.select(F.col("pivot").alias("row"), F.col("at").alias("pos")), gaps.select("row"), "row").groupBy("row").agg(F.collect_set("pos").alias("own"))
    rest = common.maybe(held, gaps.select("row"), "row").join(gaps, "row").join(own, "row", "left").select("row", "words", "gaps", "spans", "own")
    wanted = common.saved(rest.mapInArrow(asker(how, min_words), "row long, key long, pos int"), "wanted")
    n = wanted.count()
    if n:
        bits = _bits(n)
        wants = send(common.bitmap(wanted, "key", bits))
        runs = held.mapInArrow(holder(min_words, bits, wants), "row long, key long, pos int")
        runs = runs.groupBy("key").agg(F.min(F.struct("row", "pos")).alias("p"), F.max("row").alias("top"), F.count("*").alias("n")).filter("p.row <> top").drop("top")
        equal = common.lookup(wanted, common.saved(runs, "runs"), "key").filter("row <> p.row").select("row", F.col("p.row").alias("pivot"), "pos", (F.col("pos") - F.col("p.pos")).alias("drift"))
        # runs that overlap on a diagonal are one passage
        equal = equal.groupBy("row", "pivot", "drift").agg(F.array_sort(F.collect_set("pos")).alias("at"))
        begin = F.filter("at", lambda x, i: (i == 0) | (x - F.element_at("at", F.greatest(i, F.lit(1)).cast("int")) > min_words))
        equal = equal.withColumn("begin", F.explode(begin)).withColumn("later", F.filter(begin, lambda x: x > F.col("begin")))
        equal = equal.withColumn("last", F.expr("array_max(filter(at, x -> x >= begin and (size(later) = 0 or x < later[0])))")).select("row", "pivot", *(c.cast("long").alias(name) for c, name in ((F.col("begin"), "start"), (F.col("last") + min_words, "end"), (F.col("begin") - F.col("drift"), "other_start"), (F.col("last") + min_words - F.col("drift"), "other_end"), (F.col("last") + min_words - F.col("begin"), "n_equal"))))
        found = found.unionByName(equal)
    ids = table.select("row", "doc_id")
    told = found.join(ids, "row").join(ids.select(F.col("row").alias("pivot"), F.col("doc_id").alias("other_id")), "pivot")
    length = F.greatest(F.col("end") - F.col("start"), F.col("other_end") - F.col("other_start"))
    return told.select("doc_id", F.col("start").alias("start_word"), F.col("end").alias("end_word"), "other_id", "other_start", "other_end", "n_equal", (F.col("n_equal") / length).alias("similarity"))


def _matches(met: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The matches (row, pivot, pos, at, agree, pair) of seeds with their key's first one, and those (without pair) with others."""
    # one shuffle tells both: seeds of a key lie side by side, over as many tasks as it takes
    told = common.saved(met.repartitionByRange("key", "row", "pos").sortWithinPartitions("key", "row", "pos").select("key", "row", "pos", "pair", "c1", "c2").mapInArrow(matcher(), "kind int, key long, row long, pivot long, pos int, at int, agree int, pair long, c1 long, c2 long"), "told")
    # the first seeds of keys at the partitions' edges, two a partition at most
    edges = F.broadcast(told.filter("kind in (1, 2)").groupBy("key").agg(F.min(F.struct("row", "pos", "c1", "c2")).alias("p")))
    odd = lambda c: F.bit_count((F.col(c).bitwiseXOR(F.col(f"p.{c}"))).bitwiseOR(F.shiftrightunsigned(F.col(c).bitwiseXOR(F.col(f"p.{c}")), 1)).bitwiseAND(F.lit(0x5555555555555555)))
    opened = told.filter("kind = 1").drop("pivot", "at", "agree").join(edges, "key").filter("row <> p.row").select("row", F.col("p.row").alias("pivot"), "pos", F.col("p.pos").alias("at"), (64 - odd("c1") - odd("c2")).cast("int").alias("agree"), "pair")
    opened = common.saved(opened, "opened")
    matched = told.filter("kind = 0").select("row", "pivot", "pos", "at", "agree", "pair").unionByName(opened)
    # and with other holders of a seed than its first
    return matched, told.filter("kind = 3").select("row", "pivot", "pos", "at", "agree").unionByName(_met_in_cells(told, edges, odd))


def _met_in_cells(told: DataFrame, edges: DataFrame, odd) -> DataFrame:
    """(row, pivot, pos, at, agree): what closest() gives of the seeds of keys that go on from one partition to others (kind 1, with those before them, kind 2).

    A key's seeds are dealt over parts of CELL seeds, and each part that asks meets each part that is asked.
    """
    seen = told.filter("kind in (1, 2)").select("kind", "key", "row", "pos", "c1", "c2")
    parts = seen.groupBy("key").agg(F.ceil(F.count("*") / CELL).cast("int").alias("parts"), F.min("kind").alias("least_kind")).filter("least_kind = 1").drop("least_kind")
    seen = seen.join(F.broadcast(parts), "key").join(edges, "key")  # two keys a partition at most
    agree = (64 - odd("c1") - odd("c2")).cast("int")
    part = F.pmod(F.xxhash64("row", "pos"), "parts").cast("int")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    asking = seen.filter("kind = 1 and row <> p.row").withColumn("agree", agree).filter(F.col("agree") < ASK)
    asking = asking.select("key", part.alias("a"), F.explode(every).alias("b"), "row", "pos", "c1", "c2", F.greatest(F.lit(CLOSE), F.col("agree") + 1).alias("least"))
    asked = seen.filter("row <> p.row or pos <> p.pos").select("key", F.explode(every).alias("a"), part.alias("b"), "row", "pos", "c1", "c2", F.lit(0).alias("least"))
    both = asking.unionByName(asked).select(F.xxhash64("key", "a", "b").alias("cell"), "key", "row", "pos", "c1", "c2", "least")
    met = both.repartition("cell").sortWithinPartitions("cell", "key", "row", "pos", "least").mapInArrow(cells(), "key long, row long, pivot long, pos int, at int, agree int")
    # over all cells: the earliest, and the closest, the earliest of these
    best = met.groupBy("key", "row", "pos").agg(F.min(F.struct("pivot", "at", "agree")).alias("first"), F.min(F.struct((-F.col("agree")).alias("far"), "pivot", "at", "agree")).alias("most"))
    return best.select("row", "pos", F.explode(F.array_distinct(F.array("first", F.struct("most.pivot", "most.at", "most.agree")))).alias("o")).select("row", "o.pivot", "pos", "o.at", "o.agree")


def _blocks(pieces_: DataFrame, held: DataFrame) -> DataFrame:
    """(row, blocks, words) of held: only the blocks of words that pieces_ (row, low, high) lie in, and others that the bitmap takes for such."""
    n = pieces_.agg(F.sum(F.floor((F.col("high") - F.col("low")) / BLOCK) + 2)).first()[0] or 0
    bits = _bits(n)
    asked = held.sparkSession.sparkContext.broadcast(common.bitmap(pieces_.mapInArrow(block_asker(), "key long"), "key", bits))
    return held.mapInArrow(trimmer(bits, asked), "row long, blocks array<int>, words binary")


def _aligned(matched: DataFrame, held: DataFrame, k: int, min_words: int, similarity: float) -> DataFrame:
    """(row, pivot, start, end, other_start, other_end, n_equal) of the passages that chains of (row, pivot, pos, at, agree) give."""
    chains = matched.repartition("row", "pivot").sortWithinPartitions("row", "pivot", "pos", "at").mapInArrow(chainer(k), "row long, pivot long, x0 long, x1 long, y0 long, y1 long, xs array<int>, ys array<int>, ns array<int>")
    chains = common.saved(chains, "chains")
    counts = common.saved(chains.groupBy("pivot").agg(F.count("*").alias("n")), "by-pivot")
    # a pivot of many chains is dealt out: its words are needed in as many tasks
    limit = common.hot_limit(counts)
    hot = F.broadcast(counts.filter(F.col("n") > limit).select("pivot", F.ceil(F.col("n") / limit).cast("int").alias("salts")))
    # of a piece all blocks are there, one after the other
    piece = lambda c, a, b: F.expr(f"substring({c}, int(4 * ((array_position(blocks, int({a} div {BLOCK})) - 1) * {BLOCK} + {a} % {BLOCK}) + 1), int(4 * ({b} - {a})))")
    low = lambda c: F.greatest(F.lit(0).cast("long"), F.col(c) - MARGIN)
    near = chains.withColumn("ax", low("x0")).withColumn("ay", F.col("x1") + MARGIN).withColumn("bx", low("y0")).withColumn("by", F.col("y1") + MARGIN)
    near = near.join(_blocks(near.select("row", F.col("ax").alias("low"), F.col("ay").alias("high")), held), "row").withColumn("a", piece("words", "ax", "ay")).drop("words", "blocks")
    near = near.join(hot, "pivot", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("row", "x0"), "salts"), F.lit(0)).cast("int")).drop("salts")
    other = _blocks(chains.select(F.col("pivot").alias("row"), low("y0").alias("low"), (F.col("y1") + MARGIN).alias("high")), held)
    other = other.withColumnRenamed("row", "pivot").join(hot, "pivot", "left").select("pivot", "blocks", "words", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts") - 1, F.lit(0)))).alias("salt"))
    near = near.join(other, ["pivot", "salt"]).withColumn("b", piece("words", "bx", "by"))
    return near.select("row", "pivot", "ax", "a", "bx", "b", "xs", "ys", "ns").mapInArrow(aligner(min_words, similarity), "row long, pivot long, start long, end long, other_start long, other_end long, n_equal long").distinct()


def excise(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with the passages that shared() found cut out of their texts (the first holder keeps them); other columns as they are."""
    spans = found.groupBy(common.id_key(F.col("doc_id")).alias("_k")).agg(F.array_sort(F.collect_set(F.struct("start_word", "end_word"))).alias("_spans"))
    names = docs.columns
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), common.id_key(docs["doc_id"]).alias("_k")).join(spans, "_k", "left")

    @F.pandas_udf("string")
    def cut(text, spans):
        import pandas as pd

        out = []
        for t, own in zip(text, spans, strict=True):
            if t is not None and own is not None and len(own):
                data = np.frombuffer(t.encode(), np.uint8)
                _, starts, ends, _ = words(data, np.array([0, len(data)]))
                keep = np.ones(len(data), bool)
                for s in own:
                    a, b = int(s["start_word"]), min(int(s["end_word"]), len(starts))
                    if a < b:
                        keep[starts[a] : ends[b - 1]] = False
                t = data[keep].tobytes().decode()
            out.append(t)
        return pd.Series(out, dtype=object)

    new = packed.withColumn("_text", F.when(F.col("_spans").isNull(), F.col("_row.text")).otherwise(cut(F.col("_row.text"), F.col("_spans"))))
    return new.select(F.col("_row").withField("text", F.col("_text")).alias("_row")).select("_row.*")
