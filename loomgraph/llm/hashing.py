"""Hashes of all words of a buffer at once.

A word's hash is a polynomial over its bytes modulo 2^64, mixed. It comes from one running sum over the buffer: the
difference of the sums at the word's ends, taken back by the power of its start (the base is odd, so it has an inverse).
The same holds for sequences of hashes.
"""

from __future__ import annotations

import numpy as np

from .common import worker_cache

# Odd multipliers.
BASE, SEQUENCE_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ x >> np.uint64(30)
    x *= np.uint64(MIX_1)
    x ^= x >> np.uint64(27)
    x *= np.uint64(MIX_2)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of base, and of its inverse, modulo 2^64."""
    held = worker_cache(f"powers:{base}", dict)
    if len(held.get("up", ())) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for name, b in (("up", base), ("down", pow(base, -1, 1 << 64))):
            held[name] = np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, b, np.uint64))))
    return held["up"], held["down"]


def sequences(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A hash of values[start:end] for each pair of starts and ends."""
    up, down = powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def runs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs without ASCII white space in bytes that end with white space."""
    edges = np.diff(SPACE[a].view(np.int8), prepend=np.int8(1))
    return np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)


def words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts) of the runs without ASCII white space in data, which has to end with white space."""
    a = np.frombuffer(data, np.uint8)
    starts, ends = runs(a)
    return sequences(a.astype(np.uint64) + np.uint64(1), starts, ends, BASE), starts
