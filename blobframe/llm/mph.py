"""Minimal perfect hashing by hash and displace over 64-bit key hashes."""

from __future__ import annotations

import numpy as np

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S = np.uint64(32)


def _mix(x: np.ndarray, seed) -> np.ndarray:
    x = (x ^ (np.asarray(seed, dtype=np.uint64) * _M1)) * _M2
    x ^= x >> np.uint64(29)
    x *= _M1
    return x ^ (x >> _S)


class MinimalPerfectHash:
    """n distinct 64-bit hashes onto 0..n-1: a hash picks its bucket, the bucket's displacement its slot."""

    def __init__(self, n: int, seeds: np.ndarray):
        self.n, self.seeds = n, seeds
        self._list = None

    @classmethod
    def build(cls, hashes) -> MinimalPerfectHash:
        h = np.asarray(hashes, dtype=np.uint64)
        n = len(h)
        if len(np.unique(h)) != n:
            raise ValueError("key hashes must be distinct")
        buckets = max(1, (n + 3) // 4)
        with np.errstate(over="ignore"):
            of = (_mix(h, 0) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(of, kind="stable")
            counts = np.bincount(of, minlength=buckets)
            starts = np.concatenate([[0], np.cumsum(counts)])
            taken = np.zeros(max(n, 1), dtype=bool)
            seeds = np.zeros(buckets, dtype=np.uint32)
            tries = np.arange(1, 257, dtype=np.uint64)
            for b in np.argsort(-counts, kind="stable"):
                c = counts[b]
                if not c:
                    break
                keys, base = h[order[starts[b] : starts[b + 1]]], 0
                while True:
                    s = tries + np.uint64(base)
                    slots = (_mix(keys[None, :], s[:, None]) % np.uint64(n)).astype(np.int64)
                    good = ~taken[slots].any(axis=1)
                    if c > 1:
                        srt = np.sort(slots, axis=1)
                        good &= (srt[:, 1:] != srt[:, :-1]).all(axis=1)
                    if good.any():
                        k = int(good.argmax())
                        seeds[b] = base + k + 1
                        taken[slots[k]] = True
                        break
                    base += 256
        return cls(n, seeds)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """Slots of many hashes; a hash that was not a key gets some slot, which its stored fingerprint tells apart."""
        h = np.asarray(hashes, dtype=np.uint64)
        with np.errstate(over="ignore"):
            b = (_mix(h, 0) % np.uint64(len(self.seeds))).astype(np.int64)
            return (_mix(h, self.seeds[b].astype(np.uint64)) % np.uint64(max(self.n, 1))).astype(np.int64)

    def slot(self, h: int) -> int:
        if self._list is None:
            self._list = self.seeds.tolist()
        return _mix1(h, self._list[_mix1(h, 0) % len(self._list)]) % max(self.n, 1)


_MASK, _I1, _I2 = (1 << 64) - 1, int(_M1), int(_M2)


def _mix1(x: int, seed: int) -> int:
    x = ((x ^ (seed * _I1 & _MASK)) * _I2) & _MASK
    x ^= x >> 29
    x = (x * _I1) & _MASK
    return x ^ (x >> 32)
