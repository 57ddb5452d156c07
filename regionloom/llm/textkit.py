"""Vectorised text helpers for Arrow batches: byte buffers, words, word hashes, prefix sums per document.

Everything works on a whole batch of texts at once, in slices of bounded size, so a task's
memory follows the longest text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at a time; a single longer text makes a slice of its own.
SLICE_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n."""
    global _POW, _INV
    if len(_POW) < n:
        size = max(n, SLICE_BYTES + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        step = np.full(size, _BASE, np.uint64)
        step[0] = 1
        _POW = np.multiply.accumulate(step)
        step[:] = inverse
        step[0] = 1
        _INV = np.multiply.accumulate(step)
    return _POW[:n], _INV[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of about ``size`` bytes each; at least one row each."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word ``[^\\x20\\x09-\\x0D]+`` and the first word of each row.

    ``offsets`` are relative to ``data``; the third array has one more entry than there are rows.
    """
    inside = ~_SPACE[data]
    fresh = np.ones(len(data) + 1, bool)  # the byte before is no part of the same word
    fresh[1:-1] = ~inside[:-1]
    fresh[offsets] = True
    starts = np.flatnonzero(inside & fresh[:-1])
    ends = np.flatnonzero(inside & (fresh[1:] | ~np.append(inside[1:], False))) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class ByteHash:
    """Hashes of any ranges of one buffer in constant time each."""

    def __init__(self, data: np.ndarray, lower: bool = False):
        """``data`` is bytes, or 64-bit hashes of symbols."""
        power, self.inverse = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        values = (_LOWER if lower else _BYTE)[data] if data.dtype == np.uint8 else data
        np.cumsum(values * power[:-1], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, and the first word of each row (one more entry than rows)."""
    starts, ends, first = word_spans(data, offsets)
    return ByteHash(data, lower).of(starts, ends), first


def run_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every k consecutive words of a row, and the first run of each row.

    A row of fewer words, but at least one, gives one run of all its words.
    """
    n = np.diff(first)
    mult = np.uint64(_BASE)
    runs = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        runs = runs * mult + words[j:j + len(runs)]
    per = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    starts = np.concatenate([[0], np.cumsum(per)])
    row = np.repeat(np.arange(len(n)), per)
    at = first[:-1][row] + np.arange(starts[-1]) - starts[:-1][row]
    out = np.zeros(starts[-1], np.uint64)
    whole = (n >= k)[row]
    out[whole] = runs[at[whole]]
    short = np.flatnonzero((n > 0) & (n < k))
    h = n[short].astype(np.uint64)
    for j in range(k - 1):
        more = np.flatnonzero(n[short] > j)
        h[more] = h[more] * mult + words[first[:-1][short[more]] + j]
    out[starts[:-1][short]] = h
    return mix(out), starts


def with_columns(batch: pa.RecordBatch, names: list[str], arrays: list) -> pa.RecordBatch:
    """The batch with further columns behind its own."""
    fields = [*batch.schema, *(pa.field(n, a.type) for n, a in zip(names, arrays))]
    return pa.RecordBatch.from_arrays([*batch.columns, *arrays], schema=pa.schema(fields))
