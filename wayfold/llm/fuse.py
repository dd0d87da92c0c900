"""Static binary-fuse filters (three-wise, 8-bit fingerprints) over 64-bit keys."""

from __future__ import annotations

import math
import struct

import numpy as np

_HEAD = struct.Struct("<QIII")


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + np.uint64(seed)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _slots(h: np.ndarray, segment: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mask = np.uint64(segment - 1)
    h0 = ((h >> np.uint64(32)) * np.uint64(count * segment)) >> np.uint64(32)
    h1 = (h0 + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
    h2 = (h0 + np.uint64(2 * segment)) ^ (h & mask)
    return h0.astype(np.int64), h1.astype(np.int64), h2.astype(np.int64)


def _prints(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(32))).astype(np.uint8)


def build(keys: np.ndarray) -> bytes:
    """A filter over distinct uint64 keys; about nine bits a key. Empty keys give an empty filter."""
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    if not n:
        return b""
    segment = 1 << min(18, int(math.floor(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    count = max(1, -(-int(n * factor) // segment) - 2)
    with np.errstate(over="ignore"):
        for attempt in range(1, 200):
            seed = (attempt * 0x9E3779B97F4A7C15) & (2**64 - 1)
            if attempt % 20 == 0:
                count += 1 + count // 8
            h = _mix(keys, seed)
            at = np.stack(_slots(h, segment, count))
            size = (count + 2) * segment
            degree = np.bincount(at.ravel(), minlength=size)
            which = np.zeros(size, dtype=np.int64)
            for row in at:
                np.bitwise_xor.at(which, row, np.arange(n))
            order, left = [], n
            ready = np.flatnonzero(degree == 1)
            while len(ready):
                key, first = np.unique(which[ready], return_index=True)
                slot = ready[first]
                order.append((key, slot))
                left -= len(key)
                touched = at[:, key]
                np.subtract.at(degree, touched.ravel(), 1)
                np.bitwise_xor.at(which, touched.ravel(), np.tile(key, 3))
                ready = np.unique(touched.ravel())
                ready = ready[degree[ready] == 1]
            if left:
                continue
            table = np.zeros(size, dtype=np.uint8)
            prints = _prints(h)
            for key, slot in reversed(order):
                table[slot] = 0
                table[slot] = prints[key] ^ table[at[0, key]] ^ table[at[1, key]] ^ table[at[2, key]]
            return _HEAD.pack(seed, segment, count, n) + table.tobytes()
    raise ValueError("no seed peels these keys")


def contains(data: bytes, keys: np.ndarray) -> np.ndarray:
    """True for every key that was built in, and for about 1 in 256 others."""
    if not data:
        return np.zeros(len(keys), dtype=bool)
    seed, segment, count, _ = _HEAD.unpack_from(data)
    table = np.frombuffer(data, dtype=np.uint8, offset=_HEAD.size)
    with np.errstate(over="ignore"):
        h = _mix(keys.astype(np.uint64), seed)
        a, b, c = _slots(h, segment, count)
        return (table[a] ^ table[b] ^ table[c]) == _prints(h)
