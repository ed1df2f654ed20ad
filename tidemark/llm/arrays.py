"""Words and hashes of a batch of texts as numpy arrays: no per-word Python objects.

Texts are looked at as UTF-8 bytes. A batch is cut into slices of a few MB, so that the
arrays stay small however many rows an Arrow batch has; only a single text that is longer
than a slice makes a larger one.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
U = np.uint64
BASE = 0x9E3779B97F4A7C15


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """Which of the 256 byte values lie in the given closed ranges."""
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low:high + 1] = True
    return out


def lower_table() -> np.ndarray:
    """Byte map that lower-cases A-Z and leaves everything else."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the whole word."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, U)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=U)


class PrefixHash:
    """Polynomial hashes of every stretch of a sequence from its prefix sums.

    Arithmetic is modulo 2**64. Symbols pass a mixing function first, results another, so
    weak low bits don't show.
    """

    def __init__(self, values: np.ndarray, base: int = BASE):
        n = len(values)
        self.up = powers(n + 1, base)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(values * powers(n, pow(base, -1, 1 << 64)), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.up[start]
        return mixed(raw + (end - start).astype(U) * U(0xA0761D6478BD642F))


_SYMBOLS = mixed(np.arange(1, 257, dtype=U))


def byte_symbols(table: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit symbol for every byte value, after a byte map."""
    return _SYMBOLS if table is None else _SYMBOLS[table]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows; a null text is empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, at, data = texts.buffers()
    if not len(texts):
        return
    offsets = np.frombuffer(at, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, raw[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


class Words:
    """Word spans of a slice: byte start and end, row of each word, first word of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray):
        n = len(data)
        self.inside = inside = word_bytes[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(len(offsets) - 1), self.count)

    def windows(self, size: int) -> np.ndarray:
        """First words of all windows of ``size`` words that stay in their row."""
        at = np.arange(len(self.start) - size + 1)
        return at[self.row[at] == self.row[at + size - 1]] if len(at) else np.zeros(0, np.int64)


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of a byte-wise or word-wise array over each row."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def covered(starts: np.ndarray, sizes: np.ndarray | int, n: int) -> np.ndarray:
    """Which of n places lie in any of the stretches."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + sizes, -1)
    return np.cumsum(change[:-1]) > 0


def runs(flags: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal True runs that don't cross rows."""
    n = len(flags)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = flags[:-1]
    after = np.zeros(n, bool)
    after[:-1] = flags[1:]
    return np.flatnonzero(flags & (~before | edge[:-1])), np.flatnonzero(flags & (~after | edge[1:])) + 1
