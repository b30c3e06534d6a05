"""Hashes of word sequences, vectorised: what the shingle and phrase operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from xxhash import xxh3_64_intdigest

_ODD = np.random.default_rng(20).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def sequence_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Of every ``size`` words in a row; of a shorter sequence, one of the whole; of none, none."""
    n = len(words)
    size = min(size, n)
    if not size:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n - size + 1, size, dtype=np.uint64)
    for k in range(size):
        out += words[k : n - size + 1 + k] * _ODD[k % 64]
        if k % 8 == 7:
            out = mixed(out)
    return mixed(out)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def pieces(batches: Iterator[pa.Array], rows: int = 512) -> Iterator[pa.Array]:
    """Batches in smaller ones, so that what is made of one is sent before the next is made."""
    for batch in batches:
        for k in range(0, len(batch), rows):
            yield batch.slice(k, rows)
        pa.default_memory_pool().release_unused()
