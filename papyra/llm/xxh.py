"""XXH64 of many short byte spans at once.

The rule is the published one; spans of 32 bytes and more go to the library.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: The five primes of XXH64.
P1 = np.uint64(11400714785074694791)
P2 = np.uint64(14029467366897019727)
P3 = np.uint64(1609587929392839161)
P4 = np.uint64(9650029242287828579)
P5 = np.uint64(2870177450012600261)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """Unsigned 64-bit hashes of buf[start:end]."""
    size = ends - starts
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    at8 = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
    at4 = np.ndarray((len(buf) + 1,), "<u4", padded, strides=(1,))
    h = size.astype(np.uint64) + np.uint64((seed + int(P5)) & ((1 << 64) - 1))
    off = starts.copy()
    for k in range(3):
        m = np.flatnonzero(size >= 8 * (k + 1))
        if not len(m):
            break
        lane = _rotl(at8[off[m]] * P2, 31) * P1
        h[m] = _rotl(h[m] ^ lane, 27) * P1 + P4
        off[m] += 8
    m = np.flatnonzero(size & 4)
    h[m] = _rotl(h[m] ^ (at4[off[m]].astype(np.uint64) * P1), 23) * P2 + P3
    off[m] += 4
    for k in range(3):
        m = np.flatnonzero((size & 3) > k)
        h[m] = _rotl(h[m] ^ (padded[off[m] + k].astype(np.uint64) * P5), 11) * P1
    h ^= h >> np.uint64(33)
    h *= P2
    h ^= h >> np.uint64(29)
    h *= P3
    h ^= h >> np.uint64(32)
    long = np.flatnonzero(size >= 32)
    if len(long):
        raw = buf.tobytes()
        h[long] = np.fromiter((xxhash.xxh64_intdigest(raw[a:b], seed) for a, b in zip(starts[long].tolist(), ends[long].tolist())), np.uint64, len(long))
    return h
