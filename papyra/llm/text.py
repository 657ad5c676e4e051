"""Vectorised text primitives over Arrow binary columns (numpy only).

Texts travel to the workers as UTF-8 ``binary`` so nothing is decoded unless
characters are asked for. A *block* is a run of rows with a bounded number of
bytes; a longer single text forms a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
M64 = (1 << 64) - 1
#: Odd multipliers of the two independent hashes ("lanes") that spans have.
PRIMES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
PRIME = PRIMES[0]

#: Bytes that separate words: blank and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Lower-case for A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**i mod 2**64 for i < n."""
    if base not in _powers or len(_powers[base]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        out, have, step = np.empty(size, np.uint64), 1, base
        out[0] = 1
        while have < size:
            k = min(have, size - have)
            out[have : have + k] = out[:k] * np.uint64(step)
            have, step = have + k, (step * step) & M64
        _powers[base] = out
    return _powers[base][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a binary or string array; nulls are empty."""
    if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type):
        width = np.int64
    else:
        width = np.int32
    if column.null_count:
        column = column.fill_null(b"" if "binary" in str(column.type) else "")
    _, offs, data = column.buffers()
    n, o = len(column), column.offset
    if offs is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offs, width, n + 1, o * np.dtype(width).itemsize).astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, offsets


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets from 0) for runs of rows of at most ``limit`` bytes."""
    buf, offs = binary(batch.column(column))
    n, at = batch.num_rows, 0
    while at < n:
        to = int(np.searchsorted(offs, offs[at] + limit, "right")) - 1
        to = min(max(to, at + 1), n)
        yield batch.slice(at, to - at), buf[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def spans(apart: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the runs of bytes where ``apart`` is False; none crosses a row."""
    n = len(apart)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    word = ~apart
    begin = word & edge[:-1]
    begin[1:] |= word[1:] & apart[:-1]
    begin[0] = word[0]
    end = word & edge[1:]
    end[:-1] |= word[:-1] & apart[1:]
    end[-1] = word[-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offs[1:], starts, "right")


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words [^\\x20\\x09-\\x0D]+."""
    return spans(SPACE[buf], offs)


def prefix_sums(values: np.ndarray, lane: int = 0) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(PRIMES[lane], len(values)), out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """64-bit hashes of spans, the same wherever a span stands."""
    down = powers(pow(PRIMES[lane], -1, 1 << 64), len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def byte_sums(buf: np.ndarray, lane: int = 0) -> np.ndarray:
    return prefix_sums(buf.astype(np.uint64) + np.uint64(1), lane)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    return span_hashes(byte_sums(buf, lane), starts, ends, lane)


def hash_word(word: bytes) -> int:
    """The hash of one word, in plain arithmetic (the reference for tests)."""
    h = sum((b + 1) * pow(PRIME, i, 1 << 64) for i, b in enumerate(word)) + len(word) * 0xD6E8FEB86659FD93
    return int(mix(np.array([h & M64], np.uint64))[0])


def window_hashes(values: np.ndarray, rows: np.ndarray, size: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Positions i and hashes of values[i:i+size] that lie within one row."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = prefix_sums(values, lane)
    at = np.flatnonzero(rows[:n] == rows[size - 1 :])
    return at, span_hashes(sums, at, at + size, lane)


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(values, return_counts=True)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


class Lookup:
    """Index in ``keys`` (distinct 64-bit hashes) of each value; -1 if absent."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys).astype(np.int32)
        self.sorted = keys[self.order]
        bits = max(1, int(np.ceil(np.log2(len(keys) + 1))) + 4)
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.sorted >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int32)
        if not len(self.sorted):
            return out
        cell = (h >> self.shift).astype(np.int64)
        i, stop = self.first[cell], self.first[cell + 1]
        left = np.flatnonzero(i < stop)
        while len(left):
            hit = self.sorted[i[left]] == h[left]
            out[left[hit]] = self.order[i[left[hit]]]
            left = left[~hit]
            i[left] += 1
            left = left[i[left] < stop[left]]
        return out
