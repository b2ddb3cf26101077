"""numpy kernels on Arrow text columns: words, their hashes and hashes of word n-grams, without a Python object per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that are worked on together; a longer text is a piece of its own.
PIECE = 1 << 18
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
_powers: dict = {}


def lower_table() -> np.ndarray:
    """Byte to byte: A-Z to a-z, other bytes of words as they are, all else 0."""
    t = np.arange(256, dtype=np.uint8)
    t[0x41:0x5B] += 32
    for low, high in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
        t[low : high + 1] = 0
    return t


LOWER = lower_table()


def spaced_table() -> np.ndarray:
    """Byte to byte: A-Z to a-z, ASCII whitespace to 0, and byte 0, a character of words here, to one that no UTF-8 has."""
    t = np.arange(256, dtype=np.uint8)
    t[0x41:0x5B] += 32
    t[0], t[0x20], t[0x09:0x0E] = 0xFF, 0, 0
    return t


SPACED = spaced_table()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads each bit (finalizer of SplitMix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^0.. and P^-0.. modulo 2^64, n of each at least."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 2 * PIECE)
        for name, base in (("up", _P), ("down", _P_INVERSE)):
            x = np.full(size, base, dtype=U64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


def pieces(column: pa.Array, piece: int = PIECE):
    """(first row, bytes, row offsets in them) for runs of rows of about piece bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + piece, side="right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def _segment(data: np.ndarray, rows: np.ndarray, table: np.ndarray = LOWER):
    """First byte and end of each word, and the running sum from which hashes of byte ranges are taken."""
    low = table[data]
    inside = low != 0
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    cuts = rows[(rows > 0) & (rows < len(data))]
    before[cuts] = False
    after[cuts - 1] = False
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(low * powers(len(data) + 1)[0][: len(data)], out=total[1:], dtype=U64)
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1, total


def _range_hashes(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((total[ends] - total[starts]) * powers(len(total))[1][starts])


def words(data: np.ndarray, rows: np.ndarray, table: np.ndarray = LOWER):
    """Words [0-9a-z and all beyond ASCII]+ after lower-casing A-Z, or with SPACED runs of other bytes than ASCII whitespace.

    Returns hashes, first byte and end of each word, and for each row the number of its first word (one more at the end).
    """
    starts, ends, total = _segment(data, rows, table)
    return _range_hashes(total, starts, ends), starts, ends, np.searchsorted(starts, rows)


def word_features(data: np.ndarray, rows: np.ndarray, prefixes: tuple[int, ...], bits: int):
    """For each word the numbers below 2^bits of its features: the word, and its first bytes where it is longer.

    Returns features (words x (1 + prefixes); 2^bits where there is none), starts, ends and first words as words().
    """
    starts, ends, total = _segment(data, rows)
    shift = U64(64 - bits)
    out = np.full((len(starts), 1 + len(prefixes)), 1 << bits, np.int32)
    out[:, 0] = _range_hashes(total, starts, ends) >> shift
    for i, n in enumerate(prefixes):
        longer = np.flatnonzero(ends - starts > n)
        out[longer, 1 + i] = mix(_range_hashes(total, starts[longer], starts[longer] + n) + U64(n)) >> shift
    return out, starts, ends, np.searchsorted(starts, rows)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k consecutive words, rows not heeded; shorter than hashes by k - 1."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.full(n, k, U64)
    for i in range(k):
        total *= U64(0xD6E8FEB86659FD93)
        total += hashes[i : i + n]
    return mix(total)


def window_starts(first: np.ndarray, k: int) -> np.ndarray:
    """Positions at which k words of one row begin, from the numbers of the rows' first words."""
    total = int(first[-1])
    if total < k:
        return np.zeros(0, np.int64)
    ok = np.ones(total, bool)
    for i in range(1, k):
        at = first[1:] - i
        ok[at[(at >= first[:-1]) & (at >= 0)]] = False
    return np.flatnonzero(ok)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values (len(x) - w + 1 of them), by doubling."""
    have, out = 1, x
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:]) if step else out
        have += step
    return out
