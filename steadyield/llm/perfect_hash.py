"""Minimal perfect hashing of distinct 64-bit keys: n keys to the numbers 0 to n - 1.

Levels of bits: a key sets its bit on the first level where no other key
shares it, and its number is the count of bits before that one. A key that
was not among the hashed ones gets an arbitrary number or -1, so callers hold
the keys by number and compare.
"""

from __future__ import annotations

import numpy as np

from steadyield.llm.textops import U64, mix

GAMMA = 1.5  # bits a key on each level
_ONES = np.array([bin(b).count("1") for b in range(256)], dtype=np.int64)


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(keys + U64(level + 1) * U64(0x9E3779B97F4A7C15)) % U64(size)).astype(np.int64)


class PerfectHash:
    """Built from distinct keys; to_bytes and from_bytes carry it between tasks."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(_ONES[bits])]).astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        left, sizes, levels = np.asarray(keys, dtype=np.int64).view(U64), [], []
        while len(left):
            size = -8 * (-int(GAMMA * len(left) + 1) // 8)
            at = _places(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            sizes.append(size)
            left = left[~alone[at]]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, np.uint8))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 where no level has its bit."""
        keys = np.asarray(keys, dtype=np.int64).view(U64)
        out, open_ = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            at = _places(keys[open_], level, size) + self.starts[level]
            byte, bit = self.bits[at >> 3], at & 7
            is_set = (byte >> bit.astype(np.uint8)) & 1 == 1
            below = byte & ((1 << bit) - 1).astype(np.uint8)
            out[open_[is_set]] = (self.before[at >> 3] + _ONES[below])[is_set]
            open_ = open_[~is_set]
        return out

    def to_bytes(self) -> bytes:
        return np.array([len(self.sizes), *self.sizes], dtype="<i8").tobytes() + self.bits.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, "<i8", 1)[0])
        return cls(np.frombuffer(data, "<i8", n, 8).tolist(), np.frombuffer(data, np.uint8, offset=8 + 8 * n))
