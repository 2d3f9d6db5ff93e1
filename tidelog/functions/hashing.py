"""Hashes that must agree bit by bit with other systems; Spark has none of them. They run over Arrow
batches with one vector operation per byte position, not per row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

U = np.uint64
FNV_OFFSET, FNV_PRIME = U(14695981039346656037), U(1099511628211)
JUMP = 2862933555777941757
MASK = (1 << 64) - 1


def _by_byte(keys: list[bytes], start: U, step) -> np.ndarray:
    """step(hash, byte) over all keys at once, position by position."""
    size = np.array([len(k) for k in keys], np.int64)
    width = int(size.max(initial=0))
    grid = np.zeros((len(keys), width), np.uint8)
    for i, k in enumerate(keys):
        grid[i, : len(k)] = np.frombuffer(k, np.uint8)
    h = np.full(len(keys), start, U)
    for j in range(width):
        h = np.where(j < size, step(h, grid[:, j].astype(U)), h)
    return h


def fnv1a_64(keys: list[bytes]) -> np.ndarray:
    return _by_byte(keys, FNV_OFFSET, lambda h, b: (h ^ b) * FNV_PRIME)


def djb2(keys: list[bytes]) -> np.ndarray:
    return _by_byte(keys, U(5381), lambda h, b: h * U(33) + b)


def jump(h: int, buckets: int) -> int:
    """Jump consistent hashing: the last of a key's pseudo-random jumps that stays below buckets."""
    at, to = -1, 0
    while to < buckets:
        at = to
        h = (h * JUMP + 1) & MASK
        to = int((at + 1) * ((1 << 31) / ((h >> 33) + 1)))
    return at


def murmur3_32(keys: list[bytes], seed: int) -> np.ndarray:
    """MurmurHash3 x86 32-bit."""
    m = np.uint32
    rot = lambda x, r: (x << m(r)) | (x >> m(32 - r))
    size = np.array([len(k) for k in keys], np.int64)
    width = -(-int(size.max(initial=0)) // 4) * 4
    grid = np.zeros((len(keys), max(4, width)), np.uint8)
    for i, k in enumerate(keys):
        grid[i, : len(k)] = np.frombuffer(k, np.uint8)
    words = grid.view("<u4")
    h = np.full(len(keys), seed, m)
    for j in range(words.shape[1]):
        k = rot(words[:, j] * m(0xCC9E2D51), 15) * m(0x1B873593)
        whole, part = size >= 4 * (j + 1), (size > 4 * j) & (size < 4 * (j + 1))
        h = np.where(whole, rot(h ^ k, 13) * m(5) + m(0xE6546B64), np.where(part, h ^ k, h))
    h ^= size.astype(m)
    h = (h ^ (h >> m(16))) * m(0x85EBCA6B)
    h = (h ^ (h >> m(13))) * m(0xC2B2AE35)
    return h ^ (h >> m(16))


def _utf8(s: pd.Series) -> list[bytes]:
    return [x.encode() for x in s]


def routed(key: Column, shards: int, caller: int | None = None) -> Column:
    """FNV-1a modulo shards; a caller that would get itself gets the next shard."""

    @F.pandas_udf("long")
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series((fnv1a_64(_utf8(keys)) % U(shards)).astype(np.int64))

    at = shard(key)
    return at if caller is None else F.when(at == caller, (at + 1) % shards).otherwise(at)


def cache_shard(key: Column, buckets: int) -> Column:
    """djb2, then jump consistent hashing."""

    @F.pandas_udf("long")
    def bucket(keys: pd.Series) -> pd.Series:
        return pd.Series([jump(int(h), buckets) for h in djb2(_utf8(keys))], dtype="int64")

    return bucket(key)
