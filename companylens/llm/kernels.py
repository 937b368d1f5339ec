"""Vectorised byte and hash helpers that run inside tasks, on one Arrow batch at a time.

Texts are handled as UTF-8 bytes in the Arrow buffers they arrive in. Work goes through
blocks of a few megabytes, so a task's memory does not depend on its number of rows;
only a single text longer than a block makes a block longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

# The white space that separates words (space, tab to carriage return).
WHITE_SPACE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(WHITE_SPACE)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_powers: dict[int, np.ndarray] = {}


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the offsets of its rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes each, one row at least."""
    low = 0
    while low < len(offsets) - 1:
        high = int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1
        high = min(max(high, low + 1), len(offsets) - 1)
        yield low, high
        low = high


def mix(value: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads all bits of 64-bit values."""
    value = value ^ (value >> np.uint64(30))
    value = value * np.uint64(0xBF58476D1CE4E5B9)
    value = value ^ (value >> np.uint64(27))
    value = value * np.uint64(0x94D049BB133111EB)
    return value ^ (value >> np.uint64(31))


def powers(base: int, size: int) -> np.ndarray:
    """base**0 .. base**(size-1) modulo 2**64, kept for later calls."""
    known = _powers.get(base)
    if known is None or len(known) < size:
        size = max(size, BLOCK_BYTES + 1)
        known = np.empty(size, np.uint64)
        known[0] = 1
        done = 1
        while done < size:
            more = min(done, size - done)
            step = np.uint64(pow(base, done, 1 << 64))
            known[done : done + more] = known[:more] * step
            done += more
        _powers[base] = known
    return known


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums of bytes; entry i covers the bytes before i."""
    sums = np.zeros(len(data) + 1, np.uint64)
    terms = (data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data) + 1)[: len(data)]
    np.cumsum(terms, out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes have equal hashes wherever they stand."""
    shift = powers(_INVERSE, len(sums))
    return mix((sums[ends] - sums[starts]) * shift[starts])


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and the row of each word."""
    inside = ~IS_SPACE[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(data)]
    before[firsts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:] & before[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[i], starts[i]+1, .. (lengths[i] of them) one after another."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = starts.astype(np.int64) - (np.cumsum(lengths) - lengths)
    return np.repeat(shift, lengths) + np.arange(total, dtype=np.int64)


def segment_sums(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sum of values by row number."""
    return np.bincount(rows, weights=values, minlength=n)[:n]
