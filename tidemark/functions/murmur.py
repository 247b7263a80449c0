"""MurmurHash3, 32 bits, of UTF-8 text, over Arrow batches in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_C1, _C2 = np.uint32(0xCC9E2D51), np.uint32(0x1B873593)


def _rotate(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint32(n)) | (x >> np.uint32(32 - n))


def murmur3(texts: list[bytes], seed: int = 0) -> np.ndarray:
    """The hash of each value; four bytes of all values of a class of lengths at a time, so that no
    value is padded to more than twice its own length."""
    kind = np.array([(len(t) // 4).bit_length() for t in texts], dtype=np.int64)
    out = np.zeros(len(texts), dtype=np.uint32)
    for k in np.unique(kind):
        rows = np.flatnonzero(kind == k)
        out[rows] = _hashed([texts[i] for i in rows], seed)
    return out


def _hashed(texts: list[bytes], seed: int) -> np.ndarray:
    length = np.array([len(t) for t in texts], dtype=np.uint32)
    width = int(length.max()) // 4 * 4 + 4 if len(length) else 4
    data = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), dtype=np.uint8).reshape(len(texts), width)
    words = data.view("<u4").astype(np.uint32)
    h = np.full(len(texts), seed, dtype=np.uint32)
    for i in range(words.shape[1]):
        k = _rotate(words[:, i] * _C1, 15) * _C2
        block = length >= 4 * (i + 1)
        tail = ~block & (length > 4 * i)
        h = np.where(block, _rotate(h ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64), np.where(tail, h ^ k, h))
    h = h ^ length
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(16))


def murmur3_32(column: Column | str, seed: int = 0) -> Column:
    """long, 0 to 2**32 - 1; null stays null."""

    def work(values: pa.Array) -> pa.Array:
        raw = values.to_pylist()
        found = murmur3([(v or "").encode() for v in raw], seed).astype(np.int64)
        return pa.array(found, mask=np.array([v is None for v in raw], dtype=bool))

    return F.arrow_udf(work, "long")(F.col(column) if isinstance(column, str) else column)
