"""SuperMinHash signatures of many sets at once, in numpy.

Every element ranks the m slots by a random permutation of its own; its value in the slot of
rank j is j plus a random fraction, and a slot keeps the least value. The ranks of one element
are correlated, which lowers the variance against independent hashes. Level j is done for all
elements together. A slot that is filled at level j can't fall later, so a set is finished, and
its elements drop out, once all its slots are filled: the early stop of the method.
"""

from __future__ import annotations

import numpy as np

from .common import splitmix

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def signatures(hashes: np.ndarray, bounds: np.ndarray, m: int) -> np.ndarray:
    """(sets, m) uint64: level << 56 | fraction; all ones for empty sets. m is 255 at most."""
    sets = len(bounds) - 1
    sig = np.full(sets * m, _EMPTY, dtype=np.uint64)
    owner = np.repeat(np.arange(sets), np.diff(bounds))
    ranks: np.ndarray | None = None
    live = np.arange(len(hashes))
    for j in range(m):
        if not len(live):
            break
        draw = splitmix(hashes[live] + np.uint64((j + 1) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF))
        other = (j + (((draw >> np.uint64(40)) * np.uint64(m - j)) >> np.uint64(24))).astype(np.int64)
        rows = np.arange(len(live))
        if ranks is None:
            slot, held = other, other
        else:
            slot = ranks[rows, other].astype(np.int64)
            ranks[rows, other] = ranks[rows, j]
            ranks[rows, j] = slot
        flat = owner[live] * m + slot
        free = sig[flat] >= np.uint64(j) << np.uint64(56)
        value = np.uint64(j) << np.uint64(56) | splitmix(draw) >> np.uint64(8)
        np.minimum.at(sig, flat[free], value[free])
        open_ = (sig.reshape(sets, m) == _EMPTY).any(axis=1)
        keep = open_[owner[live]]
        if ranks is None:
            if keep.any():
                ranks = np.tile(np.arange(m, dtype=np.uint8), (int(keep.sum()), 1))
                rows, held = np.arange(len(ranks)), held[keep]
                ranks[rows, held] = 0
                ranks[:, 0] = held
        else:
            ranks = ranks[keep]
        live = live[keep]
    return sig.reshape(sets, m)


def bands(sig: np.ndarray, rows: int) -> np.ndarray:
    """(sets, bands) uint64: a hash of each run of ``rows`` slots, together with its place."""
    sets, m = sig.shape
    parts = sig[:, : m // rows * rows].reshape(sets, m // rows, rows)
    out = np.broadcast_to(np.arange(m // rows, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(rows):
        out = splitmix(out * np.uint64(0x9E3779B97F4A7C55) + parts[:, :, k])
    return out
