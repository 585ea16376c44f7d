"""Vectorised words and word n-grams over Arrow text columns.

A group of texts is one byte buffer with boundaries. Words get 64-bit hashes from prefix sums of a
polynomial over byte values, n-grams from prefix sums over word hashes, so the cost per byte is a few
array operations and memory is bounded by the group size (or by one very long text).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLAB = 1 << 20
GROUP = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, U64)
    out[0] = 1
    if n > 1:
        out[1:] = U64(base)
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of an odd number and of its inverse, modulo 2^64, as far as they were needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = _powers(self.base, 2 * n), _powers(self.inverse, 2 * n)
        return self.up, self.down


_BYTES, _WORDS = _Powers(0x9E3779B97F4A7C13), _Powers(0xD6E8FEB86659FD93)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
VALUES = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
LOWER = np.arange(256)
LOWER[65:91] += 32
VALUES_LOWER = VALUES[LOWER]


def give_back() -> None:
    """Return freed memory of this worker to the system; workers are kept between stages."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def text_groups(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = GROUP) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, bounds): slices of at most about limit bytes of text, or of one longer text. Null counts as empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and texts.buffers()[2].size else np.zeros(0, np.uint8)
        row = 0
        while row < len(texts):
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
            end = min(end, len(texts))
            yield batch.slice(row, end - row), data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
            row = end
    give_back()


def word_bounds(data: np.ndarray, bounds: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words per text) of the words of a group."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds) - 1, np.int64)
    solid = ~space[data]
    cut = np.zeros(n + 1, bool)
    cut[bounds] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | cut[1:n]
    last[:-1] &= ~solid[1:] | cut[1:n]
    starts = np.flatnonzero(first)
    counts = np.diff(np.searchsorted(starts, bounds))
    return starts, np.flatnonzero(last) + 1, counts


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = VALUES) -> np.ndarray:
    """A 64-bit hash of each word."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + SLAB, side="right")))
        span = data[base : ends[j - 1]]
        up, down = _BYTES.get(len(span) + 1)
        sums = np.zeros(len(span) + 1, U64)
        np.cumsum(values[span] * up[: len(span)], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[e] - sums[s]) * down[s]
        i = j
    return mix(out)


def gram_hashes(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash of each run of k words; the result has len(words) - k + 1 entries, runs across texts included."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    if seed:
        words = mix(words ^ U64(seed))
    out = np.empty(n, U64)
    i = 0
    while i < n:
        j = min(n, i + SLAB)
        part = words[i : j + k - 1]
        up, down = _WORDS.get(len(part) + 1)
        sums = np.zeros(len(part) + 1, U64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        m = j - i
        out[i:j] = (sums[k : k + m] - sums[:m]) * down[:m]
        i = j
    return mix(out)


def grams_inside(counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into gram_hashes, text, position in the text) of the runs of k words that lie inside one text."""
    first = np.cumsum(counts) - counts
    runs = np.maximum(counts - k + 1, 0)
    text = np.repeat(np.arange(len(counts)), runs)
    pos = np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs)
    return first[text] + pos, text, pos
