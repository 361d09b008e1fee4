"""Vectorised 64-bit hashes of byte strings inside one flat buffer."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)            # odd, so it has an inverse modulo 2^64
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def _grown(table: np.ndarray, base: np.uint64, n: int) -> np.ndarray:
    while len(table) < n:
        top = table[-1] * base
        table = np.concatenate([table, table * top])
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


class Spans:
    """Hashes of any spans of ``raw`` (an array of bytes or of code points) from one
    prefix sum."""

    def __init__(self, raw: np.ndarray):
        global _powers, _inverses
        with np.errstate(over="ignore"):
            value = _BYTE[raw] if raw.dtype == np.uint8 else mix(raw.astype(U) + U(1))
            _powers = _grown(_powers, _BASE, len(raw) + 1)
            _inverses = _grown(_inverses, _INVERSE, len(raw) + 1)
            self.prefix = np.empty(len(raw) + 1, dtype=np.uint64)
            self.prefix[0] = 0
            np.cumsum(value * _powers[:len(raw)], out=self.prefix[1:])

    def hash(self, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self.prefix[end] - self.prefix[start]) * _inverses[start]
            return mix(h + (end - start).astype(np.uint64) * U(0xA24BAED4963EE407) + U(seed))

    def least_in_windows(self, gram: int, width: int, chunk: int = 1 << 15) -> np.ndarray:
        """For every ``width`` adjacent spans of ``gram`` the position of the span with
        the least hash (the leftmost of equal ones). Works in chunks that stay in
        the processor's cache; positions are packed relative to their chunk, so the
        buffer may have any length."""
        low = U((1 << max(26, (chunk + width).bit_length())) - 1)
        total = len(self.prefix) - gram - width + 1
        out = np.empty(max(0, total), dtype=np.int32 if len(self.prefix) <= 1 << 31 else np.int64)
        with np.errstate(over="ignore"):
            for i in range(0, total, chunk):
                e = min(total, i + chunk)
                hi = e + width - 1
                h = self.prefix[i + gram:hi + gram] - self.prefix[i:hi]
                h *= _inverses[i:hi]
                h ^= h >> U(32)
                h *= U(0xD6E8FEB86659FD93)
                h ^= h >> U(32)
                h &= ~low
                h |= np.arange(hi - i, dtype=np.uint64)
                have = 1
                while have < width:              # sliding minimum by doubling
                    step = min(have, width - have)
                    h = np.minimum(h[:-step], h[step:])
                    have += step
                h &= low
                h += U(i)
                out[i:e] = h
        return out
