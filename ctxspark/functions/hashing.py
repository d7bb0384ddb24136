"""The 64-bit hash behind splits and shuffles, on Arrow batches in numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Offset and prime of the byte hash, multipliers of the finalizer, and the epoch's multiplier.
OFFSET, PRIME = 1469598103934665603, 1099511628211
MIX_1, MIX_2, GOLDEN = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1


def byte_hash(keys: list[bytes]) -> np.ndarray:
    """XOR with each byte, then times the prime; all keys step by step together."""
    size = np.fromiter(map(len, keys), np.int64, len(keys))
    h = np.full(len(keys), OFFSET, np.uint64)
    if not len(keys) or not size.max():
        return h
    order = np.argsort(-size, kind="stable")
    flat = np.frombuffer(b"".join(keys), np.uint8).astype(np.uint64)
    start = (np.cumsum(size) - size)[order]
    size, out = size[order], h.copy()
    for k in range(int(size[0])):
        n = int(np.searchsorted(-size, -k, "left"))
        out[:n] = (out[:n] ^ flat[start[:n] + k]) * np.uint64(PRIME)
    h[order] = out
    return h


def avalanche(h: np.ndarray) -> np.ndarray:
    for m in (MIX_1, MIX_2):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(m)
    return h ^ (h >> np.uint64(33))


def snapshot_hash(keys: list[bytes], seed: int, epoch: int) -> np.ndarray:
    return avalanche(byte_hash(keys) ^ np.uint64((seed ^ (epoch * GOLDEN)) & _ALL))


def _udf(finish, kind: T.DataType):
    def make(key: Column, seed: int, epoch: int) -> Column:
        @F.pandas_udf(kind)
        def run(keys: pd.Series) -> pd.Series:
            return pd.Series(finish(snapshot_hash([k.encode() for k in keys.fillna("NULL")], seed, epoch)))

        return run(key)

    return make


def bucket(key: Column, seed: int, epoch: int = 0) -> Column:
    """hash modulo 100 as bigint; a null key counts as the text NULL."""
    return _udf(lambda h: (h % np.uint64(100)).astype(np.int64), T.LongType())(key, seed, epoch)


def hex_hash(key: Column, seed: int, epoch: int = 0) -> Column:
    """16 hexadecimal digits, so that text order is unsigned order."""
    return _udf(lambda h: [f"{x:016x}" for x in h.tolist()], T.StringType())(key, seed, epoch)
