"""The 64-bit Murmur variant that places keys on partitions, over Arrow batches.

Spark's own hash functions differ from it and its products wrap at 64 bits, which ANSI arithmetic
refuses; so keys of one length are hashed together in numpy.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the hash.
C1, C2 = np.uint64(0x87C37B91114253D5), np.uint64(0x4CF5AD432745937F)
F1, F2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
ADD = np.uint64(0x52DCE729)
PARTITION_SEED = 0x10000001F


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _lane(words: np.ndarray, first: np.uint64, by: int, second: np.uint64) -> np.ndarray:
    return _turn(words * first, by) * second


def _equal_length(rows: np.ndarray, seed: int) -> np.ndarray:
    """Rows of equally many bytes."""
    n, length = rows.shape
    h = np.full(n, seed, np.uint64)
    whole = length // 16 * 16
    words = np.ascontiguousarray(rows[:, :whole]).view("<u8").reshape(n, -1)
    for k in range(0, words.shape[1], 2):
        h = _turn(h ^ _lane(words[:, k], C1, 31, C2), 27) * np.uint64(5) + ADD
        h = h ^ _lane(words[:, k + 1], C2, 33, C1)
    rest = length - whole
    if rest:
        padded = np.zeros((n, 16), np.uint8)
        padded[:, :rest] = rows[:, whole:]
        low, high = padded.view("<u8")[:, 0], padded.view("<u8")[:, 1]
        if rest > 8:
            h = h ^ _lane(high, C2, 33, C1)
        h = h ^ _lane(low, C1, 31, C2)
    h = h ^ np.uint64(length)
    for factor in (F1, F2):
        h = (h ^ (h >> np.uint64(33))) * factor
    return h ^ (h >> np.uint64(33))


def murmur64(keys: list[bytes], seed: int = 0) -> np.ndarray:
    out = np.zeros(len(keys), np.uint64)
    by_length: dict[int, list[int]] = {}
    for i, k in enumerate(keys):
        by_length.setdefault(len(k), []).append(i)
    for length, at in by_length.items():
        rows = np.frombuffer(b"".join(keys[i] for i in at), np.uint8).reshape(len(at), length)
        out[at] = _equal_length(rows, seed)
    return out


def murmur_hash(key: Column, seed: int = 0) -> Column:
    """The hash's bits as a signed long; null for null."""

    @F.pandas_udf("long")
    def of(keys: pd.Series) -> pd.Series:
        there = keys.notna()
        out = pd.Series([None] * len(keys), dtype="Int64")
        out[there.to_numpy()] = murmur64([k.encode() for k in keys[there]], seed).view(np.int64)
        return out

    return of(key.cast("string"))


def partition_of(key: Column, partitions: int = 4096, seed: int = PARTITION_SEED) -> Column:
    """The unsigned hash modulo the number of partitions, which is a power of two."""
    if partitions & (partitions - 1):
        raise ValueError("partitions must be a power of two")
    return murmur_hash(key, seed).bitwiseAND(F.lit(partitions - 1)).cast("int")
