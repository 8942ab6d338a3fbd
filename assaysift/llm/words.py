"""Vectorised words and shingles of whole Arrow text columns.

Texts are handled as UTF-8 bytes in pieces of half a megabyte, so the memory a task needs does not depend on the size of a
batch, only on the longest single text. Words are hashed to 64 bits by a rolling polynomial and mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is a piece of its own.
PIECE_BYTES = 1 << 19
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_UNBASE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words that end at ASCII white space only.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words made of ASCII letters and digits and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Return a bijective scrambling of unsigned 64-bit numbers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Return the bytes of a string column, nulls as empty texts, and the offsets of its rows."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    if not (wide or pa.types.is_string(column.type)):
        column, wide = column.cast(pa.large_string()), True
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)
    return (data[offsets[0] : offsets[-1]], offsets - offsets[0]) if len(column) else (data[:0], np.zeros(1, np.int64))


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (first row, bytes, offsets) of runs of rows of about ``limit`` bytes."""
    data, offsets = text_bytes(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Return start, end and first-word index per row of the words made of the bytes in ``kind``."""
    size = len(data)
    if not size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = kind[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begin = offsets[:-1][offsets[:-1] < size]
    first[begin] = inside[begin]
    stop = offsets[1:][offsets[1:] > 0] - 1
    last[stop] = inside[stop]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, offsets)


_powers: list[np.ndarray] = []


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < size:
        n = max(size, PIECE_BYTES + 1)
        tables = []
        for base in (_BASE, _UNBASE):
            table = np.full(n, base, np.uint64)
            table[0] = 1
            tables.append(np.cumprod(table, dtype=np.uint64))
        _powers[:] = tables
    return _powers[0], _powers[1]


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Return a 64-bit hash of each word with A-Z lower-cased."""
    if not len(start):
        return np.zeros(0, np.uint64)
    power, unpower = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * unpower[start] + (end - start).astype(np.uint64) * _ODD)


def ngrams(words: np.ndarray, first: np.ndarray, n: int, whole_if_short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Return hashes of the n-grams of every row and the index of each row's first one.

    A row with fewer than ``n`` words has its whole sequence as one n-gram, or none.
    """
    counts = np.diff(first)
    grams = np.zeros(0, np.uint64)
    weights = [mix(np.array([i + 1], np.uint64))[0] | np.uint64(1) for i in range(n)]
    if len(words) >= n:
        grams = words[: len(words) - n + 1] * weights[0]
        for i in range(1, n):
            grams = grams + words[i : len(words) - n + 1 + i] * weights[i]
        grams = mix(grams + np.uint64(n))
    rows = np.repeat(np.arange(len(counts)), np.maximum(counts - n + 1, 0))
    lengths = np.maximum(counts - n + 1, 0)
    at = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(lengths, out=at[1:])
    long_grams = grams[first[rows] + np.arange(len(rows)) - at[rows]] if len(rows) else np.zeros(0, np.uint64)
    if not whole_if_short:
        return long_grams, at
    lengths = np.where(counts > 0, np.maximum(lengths, 1), 0)
    out_at = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(lengths, out=out_at[1:])
    out = np.empty(out_at[-1], np.uint64)
    out[out_at[rows] + np.arange(len(rows)) - at[rows]] = long_grams
    for c in range(1, n):
        short = np.flatnonzero(counts == c)
        if len(short):
            value = words[first[short]] * weights[0]
            for i in range(1, c):
                value = value + words[first[short] + i] * weights[i]
            out[out_at[short]] = mix(value + np.uint64(c))
    return out, out_at
