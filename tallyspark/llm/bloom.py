"""Bloom filters over keys given as two 64-bit hashes: bit arrays of numpy words, built by a grouped bit_or."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY, PROBES = 10, 5


def _positions(a: np.ndarray, b: np.ndarray, level: int, m: int) -> np.ndarray:
    """Bit positions of keys, one row for each key; filters of different levels err on different keys."""
    with np.errstate(over="ignore"):
        mixed = (a.astype(np.uint64) ^ np.uint64((level * 0x9E3779B97F4A7C15) & (2**64 - 1))) * np.uint64(0xFF51AFD7ED558CCD)
        mixed ^= mixed >> np.uint64(32)
        step = b.astype(np.uint64) | np.uint64(1)
        return (mixed[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(m)


def bloom_hit(bits: np.ndarray, a: np.ndarray, b: np.ndarray, level: int = 1) -> np.ndarray:
    at = _positions(a, b, level, len(bits) * 64)
    return ((bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)


def error_rate(bits_per_key: float) -> float:
    """How often a filter with so many bits for each of its keys takes another key."""
    return (1 - math.exp(-PROBES / bits_per_key)) ** PROBES


def bloom_bits(keys: DataFrame, max_bits: int, level: int = 1, bits_per_key: float = BITS_PER_KEY) -> np.ndarray:
    """The filter of `keys` (a, b). Never over max_bits: beyond that it errs more often."""
    n = keys.count()
    m = min(max_bits, max(64, 1 << math.ceil(math.log2(max(1, n * bits_per_key)))))

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            at = np.unique(_positions(x["a"].to_numpy(), x["b"].to_numpy(), level, m).ravel())
            yield pd.DataFrame({"word": (at >> np.uint64(6)).astype(np.int64), "bit": (np.uint64(1) << (at & np.uint64(63))).view(np.int64)})

    bits = np.zeros(m // 64, np.int64)
    found = keys.mapInPandas(words, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit")).toPandas()
    bits[found["word"].to_numpy(np.int64)] = found["bit"].to_numpy(np.int64)
    return bits.view(np.uint64)
