"""Hashes of many byte ranges at once. All arithmetic is modulo 2**64."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: An odd base.
BASE = 0x5851F42D4C957F2D


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads each value over all 64 bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Ranges:
    """hash(start, end) of ranges of a byte array: equal bytes give equal values, wherever they stand."""

    def __init__(self, data: np.ndarray, base: int = BASE):
        n = len(data)
        self.sums = np.zeros(n + 1, U)
        np.cumsum((data.astype(U) + U(1)) * np.cumprod(np.full(n, base, U)), out=self.sums[1:])
        self.back = np.cumprod(np.concatenate([[U(1)], np.full(n, pow(base, -1, 1 << 64), U)]))

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] ^ (end - start).astype(U) * U(0x9E3779B97F4A7C15))


def words8(data: np.ndarray, n: int) -> np.ndarray:
    """The 8 bytes from each of the first n places on, as one number; data has 8 bytes more than n."""
    two = data[:-1].astype(U) | data[1:].astype(U) << U(8)
    four = two[:-2] | two[2:] << U(16)
    return (four[:-4] | four[4:] << U(32))[:n]
