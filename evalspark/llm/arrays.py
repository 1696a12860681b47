"""Numpy helpers for text in Arrow batches: word bounds, word hashes, n-gram hashes.

Texts stay one byte buffer with offsets, as Arrow holds them, and every step is a vector
operation over the buffer. Batches are cut into pieces of a megabyte, so that a
worker's memory follows the piece (or the longest single text), not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; up to ten arrays of eight bytes a byte live with them.
PIECE = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = np.ones(1, np.uint64)
_inverse_powers = np.ones(1, np.uint64)

#: Byte tables: True for the bytes of a word.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False
ALPHANUMERIC = np.ones(256, bool)
# letters count in both cases: words are taken from lower-cased text
ALPHANUMERIC[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse modulo 2**64."""
    global _powers, _inverse_powers
    if len(_powers) < n:
        size = max(n, PIECE + 1)
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            made = np.cumprod(steps, dtype=np.uint64)
            if base is _BASE:
                _powers = made
            else:
                _inverse_powers = made
    return _powers[:n], _inverse_powers[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stretches(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most ``limit`` bytes of text, or one longer text."""
    sizes = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(sizes):
        before = int(sizes[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(sizes, before + limit, "right")))
        yield first, last
        first = last


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, offsets)`` of runs of rows; null texts are empty.

    A run holds at most ``limit`` bytes, or one longer text.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1)
        yield first, raw[bounds[first]:bounds[last]], bounds[first:last + 1] - bounds[first]
        first = last


def word_bounds(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and its row; words end at the end of a row."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = table[data]
    before, after = inside[:-2].copy(), inside[2:].copy()
    full = offsets[:-1] < offsets[1:]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    inside = inside[1:-1]
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def prefix_hash(data: np.ndarray, values: np.ndarray = _BYTE_VALUES) -> np.ndarray:
    """Running polynomial hash of a buffer, with a leading zero."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up, dtype=np.uint64, out=out[1:])
    return out


def span_hashes(running: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes give equal hashes wherever they stand."""
    _, down = powers(len(running))
    return mix((running[ends] - running[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    return span_hashes(prefix_hash(data, _BYTE_VALUES[LOWER] if lower else _BYTE_VALUES), starts, ends)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of ``n`` consecutive word hashes, one per start; the caller drops runs over a row's end."""
    size = max(0, len(words) - n + 1)
    out = np.full(size, n, np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(3) + words[k:k + size])
    return out


def row_counts(rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, minlength=n).astype(np.int64)
