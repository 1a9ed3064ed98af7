"""64-bit hashes of words and word sequences, vectorised."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    """A hash per word; bytes.split parts at exactly the characters 0x20 and 0x09-0x0D."""
    words = text.split()
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(words: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A hash per window of size consecutive words; empty if there are fewer words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, 0x9E3779B97F4A7C15 * (2 * seed + 1) % 2**64, np.uint64)
    for i in range(size):
        out = mix(out + _GOLDEN) + words[i : i + n] if i % 4 == 0 else out * _M2 + words[i : i + n]
    return mix(out)


def sequence_hash(words: np.ndarray, seed: int = 0) -> int:
    return xxh3_64_intdigest(words.tobytes(), seed)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
