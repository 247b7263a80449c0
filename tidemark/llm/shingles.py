"""Word shingles of many texts at once, as 64-bit hashes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import splitmix

#: Bytes of text that are hashed at a time; a longer single text is taken whole.
CHUNK = 1 << 18
_MULTIPLIER = 0x9E3779B97F4A7C55


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each byte: is it white space, and a random number, the same for both cases of A-Z."""
    space = np.zeros(256, dtype=bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    fold = np.arange(256)
    fold[65:91] += 32
    return space, splitmix(np.arange(256, dtype=np.uint64) * np.uint64(7919) + np.uint64(1))[fold]


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows and the end) of a string array; nulls are empty."""
    whole = texts.cast(pa.large_binary()).fill_null(b"") if texts.null_count else texts.cast(pa.large_binary())
    off = np.frombuffer(whole.buffers()[1], dtype=np.int64)[whole.offset : whole.offset + len(whole) + 1] if len(whole) else np.zeros(1, np.int64)
    data = np.frombuffer(whole.buffers()[2], dtype=np.uint8) if len(whole) and whole.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(whole):
        end = max(at + 1, int(np.searchsorted(off, off[at] + CHUNK, side="right")) - 1)
        yield at, end, data[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, A-Z in lower case, and the row that it is in."""
    space, number = _tables()
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    solid = ~space[data]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(data)]
    start[firsts] = solid[firsts]
    at = np.flatnonzero(start)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    length = np.add.reduceat(solid, at, dtype=np.int64)
    powers = np.cumprod(np.full(int(length.max()) + 1, _MULTIPLIER, dtype=np.uint64))
    body = np.flatnonzero(solid)
    begin = np.cumsum(length) - length  # of each word among the solid bytes
    value = number[data[body]] * powers[np.arange(len(body)) - np.repeat(begin, length)]
    hashes = splitmix(np.add.reduceat(value, begin) + length.astype(np.uint64))
    return hashes, np.searchsorted(offsets, at, side="right") - 1


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of k words in a row, sorted within each row, and the rows' bounds among them.

    A row of fewer words has the whole sequence as its one shingle, a row without words none.
    """
    words, row = word_hashes(data, offsets)
    rows = len(offsets) - 1
    n = np.bincount(row, minlength=rows)
    out = words.copy()
    for j in range(1, k):
        out[: len(out) - j] = splitmix(out[: len(out) - j] * np.uint64(3) + words[j:])
    first = np.cumsum(n) - n
    here = np.arange(len(words)) - first[row] + k <= n[row]
    hashes, owner = out[here], row[here]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        whole = []
        for r in short:
            h = int(n[r])
            for w in words[first[r] : first[r] + n[r]].tolist():
                h = int(splitmix(np.array([h * 5 + w & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64))[0])
            whole.append(h)
        hashes, owner = np.append(hashes, np.array(whole, np.uint64)), np.append(owner, short)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    keep = np.ones(len(hashes), dtype=bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[keep], owner[keep]
    return hashes, np.searchsorted(owner, np.arange(rows + 1))
