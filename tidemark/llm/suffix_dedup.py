"""Removal of repeated byte strings with suffix arrays and longest-previous-factor arrays.

Every byte goes that lies in a WIDTH-byte string which also starts in a document with a smaller
id. Suffixes of the whole corpus can't be sorted in one place, so they are dealt out by content:

1. The anchor of a string of WIDTH bytes is the leftmost of its GRAM-byte grams with the least
   hash. Equal strings have equal anchors at equal places, so only strings whose anchor occurs
   in two documents can repeat. Anchors are packed by hash and meet in one exchange; each map
   task first merges what it has, so a very common anchor costs one entry per task.
2. Around each shared anchor lies a segment: the strings whose anchor it is. Segments meet by
   the anchor's hash. A map task sends a segment that several of its documents hold once, with
   the least of these; the others are later copies for certain. Anchors with more places than a
   partition's even share are hot: their strings meet one by one, by their own hash.
3. In each bucket of anchors the distinct segments form a text, in the order of their documents;
   a segment that further documents hold comes in a second time, for all of these. A suffix array
   of its strings, to a depth of WIDTH bytes, and the previous and the next smaller document in
   suffix order give each string's longest previous factor: its length and its source. Strings
   with a factor of WIDTH bytes are covered.
4. The covered runs come back to the documents and are cut out.

Texts cross the network once: both joins read the same exchange, so both take all columns.
Buckets follow the bytes of text (PART), so a task's share doesn't grow with the corpus.

Defined cases: a null text is empty; texts under WIDTH bytes lose nothing; a null id comes before
all others; rows with equal ids (null ones too) don't count as each other's copies, and each has
the runs of its own text; texts of any length are read in pieces that overlap by WIDTH - 1 bytes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import process_memory, read, splitmix, stored
from .grouping import by_group

WIDTH, GRAM = 50, 16
#: Bytes hashed at a time (positions must fit _AT bits), and bytes of text a map task merges before it packs.
PIECE, UNIT = 1 << 18, 32 << 20
_AT = 21
#: Bytes of text per bucket of anchors, each a partition (there are never fewer than the session's shuffle
#: partitions), and strings of a bucket that are sorted at a time.
PART, PORTION = 32 << 20, 1 << 16
#: Anchors of a bucket that may be told as frequent.
FREQUENT = 64
_NO_ID = -(1 << 63)


# --- anchors --------------------------------------------------------------------------------


def least_in_windows(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of width values."""
    done, out = 1, x
    while done * 2 <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    if done < width:
        rest = width - done
        out = np.minimum(out[: len(out) - rest], out[rest:])
    return out


def anchors(data: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For bytes of one piece: hash and place of each anchor, first window and end window of its run."""
    h, done = data.astype(np.uint64) + np.uint64(1), 1
    power = 0x9E3779B97F4A7C55
    while done < gram:
        h = h[:-done] + h[done:] * np.uint64(power)
        power = power * power & 0xFFFFFFFFFFFFFFFF
        done *= 2
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    h = (h >> np.uint64(_AT)) << np.uint64(_AT) | np.arange(len(h), dtype=np.uint64)
    low = least_in_windows(h, width - gram + 1)
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    picked = low[first]
    return picked >> np.uint64(_AT), (picked & np.uint64((1 << _AT) - 1)).astype(np.int64), first, np.append(first[1:], len(low))


def pieces(offsets: np.ndarray, width: int = WIDTH) -> Iterator[tuple[int, int, int]]:
    """(row, start, end) in bytes of the rows' texts; rows that are too short have none."""
    for row in range(len(offsets) - 1):
        a, b = int(offsets[row]), int(offsets[row + 1])
        while b - a >= width:
            yield row, a, min(b, a + PIECE)
            if a + PIECE >= b:
                break
            a += PIECE - width + 1


def _batched_anchors(data: np.ndarray, offsets: np.ndarray):
    """Anchors of all rows: row, hash, place in the row's text, first window and end window there.

    Short rows are hashed together; windows that cross rows are dropped.
    """
    out = [[], [], [], [], []]
    group: list[tuple[int, int, int]] = []

    def flush() -> None:
        if not group:
            return
        base = group[0][1]
        span = data[base : group[-1][2]]
        key, at, lo, hi = anchors(span)
        starts = np.array([g[1] - base for g in group])
        ends = np.array([g[2] - base for g in group])
        # A run may reach over the end of a row or begin before one: cut it at both.
        which = np.searchsorted(starts, at, side="right") - 1
        rows = np.array([g[0] for g in group])
        origin = np.array([g[1] - int(offsets[g[0]]) for g in group])
        keep = which >= 0
        key, at, lo, hi, which = key[keep], at[keep], lo[keep], hi[keep], which[keep]
        lo, hi = np.maximum(lo, starts[which]), np.minimum(hi, ends[which] - WIDTH + 1)
        keep = lo < hi
        key, at, lo, hi, which = key[keep], at[keep], lo[keep], hi[keep], which[keep]
        shift = origin[which] - starts[which]
        for o, v in zip(out, (rows[which], key, at + shift, lo + shift, hi + shift), strict=True):
            o.append(v)
        group.clear()

    for piece in pieces(offsets):
        if group and piece[2] - group[0][1] > PIECE:
            flush()
        group.append(piece)
    flush()
    kinds = (np.int64, np.uint64, np.int64, np.int64, np.int64)
    return tuple(np.concatenate(o) if o else np.zeros(0, k) for o, k in zip(out, kinds, strict=True))


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    whole = column.cast(pa.large_binary()).fill_null(b"")
    if not len(whole):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(whole.buffers()[1], dtype=np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = np.frombuffer(whole.buffers()[2], dtype=np.uint8) if whole.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


# --- packing --------------------------------------------------------------------------------


def pack(*columns: np.ndarray) -> bytes:
    """Integer columns of equal length: byte planes, compressed together."""
    n = len(columns[0])
    raw = b"".join(np.ascontiguousarray(c.astype(np.int64).view(np.uint8).reshape(n, 8).T).tobytes() for c in columns)
    return n.to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes, columns: int) -> list[np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(pa.decompress(blob[8:], decompressed_size=n * 8 * columns, codec="zstd", asbytes=True), dtype=np.uint8)
    return [np.ascontiguousarray(raw[i * 8 * n : (i + 1) * 8 * n].reshape(8, n).T).view(np.int64).ravel() for i in range(columns)]


_ROWS = "bucket int, kind int, payload binary"
_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def _per_target(targets: int, doc: np.ndarray, row: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(target, packed ids, rows and columns): a target is a bucket of documents, so that a task
    sends a few packs and not a row for each document that it has something on."""
    if not len(doc):
        return
    to = (splitmix(doc.astype(np.int64).view(np.uint64) ^ row.view(np.uint64)) % np.uint64(targets)).astype(np.int64)
    order = np.lexsort((row, doc, to))
    to, doc, row, columns = to[order], doc[order], row[order], [c[order] for c in columns]
    cuts = _groups(to)
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield int(to[a]), pack(doc[a:b], row[a:b], *(c[a:b] for c in columns))


_BY_DOC = "doc_id long, row long, payload binary"


def _by_doc(columns: int):
    """(doc_id, row, payload) once for each document of a target, from all packs on it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, ("bucket",)):
            parts = [unpack(x, 2 + columns) for x in t["payload"].to_pylist()]
            doc, row, *rest = (np.concatenate([p[i] for p in parts]) for i in range(2 + columns))
            order = np.lexsort((row, doc))
            doc, row, rest = doc[order], row[order], [c[order] for c in rest]
            cuts = _groups(doc, row)
            rows = [(int(doc[a]), int(row[a]), b"".join(_plain(c[a:b]) for c in rest)) for a, b in zip(cuts, cuts[1:], strict=False)]
            for i in range(0, len(rows), 4096):
                ids, which, blobs = zip(*rows[i : i + 4096], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(which, pa.int64()), pa.array(blobs, pa.binary())], names=["doc_id", "row", "payload"])

    return run


def _plain(c: np.ndarray) -> bytes:
    return len(c).to_bytes(4, "little") + c.astype(np.int64).tobytes()


def _plains(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        n = int.from_bytes(blob[at : at + 4], "little")
        out.append(np.frombuffer(blob, dtype=np.int64, count=n, offset=at + 4))
        at += 4 + 8 * n
    return out


def _groups(*sorted_: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values (of equal tuples of values), and the end."""
    if not len(sorted_[0]):
        return np.zeros(1, np.int64)
    change = np.zeros(len(sorted_[0]) - 1, dtype=bool)
    for c in sorted_:
        change |= c[1:] != c[:-1]
    return np.flatnonzero(np.concatenate([[True], change, [True]]))


# --- step 1: anchors that two documents have -------------------------------------------------


def _offered(buckets: int, targets: int):
    """Packs a task's anchors by bucket. Those that two of its own documents have are known to be
    shared: their places go straight on (kind 0), and one entry without a document tells others."""

    def packed(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        key, doc, row, at = (np.concatenate(c) for c in zip(*held, strict=True))
        if not len(key):
            return
        order = np.lexsort((doc, key))
        key, doc, row, at = key[order], doc[order], row[order], at[order]
        cuts = _groups(key)
        size = np.diff(cuts)
        shared = np.repeat(doc[cuts[:-1]] != doc[cuts[1:] - 1], size)
        rows = [(t, 0, blob) for t, blob in _per_target(targets, doc[shared], row[shared], at[shared])]
        told = np.flatnonzero(shared & np.concatenate([[True], key[1:] != key[:-1]]))
        flag = np.zeros(len(key), dtype=np.int64)
        flag[told] = 1
        send = ~shared | (flag > 0)
        at = np.where(flag > 0, np.repeat(size, size), at)  # the entry that tells others has the number of places
        key, doc, row, at, flag = key[send], np.where(flag > 0, 0, doc)[send], np.where(flag > 0, 0, row)[send], at[send], flag[send]
        to = (key % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        key, doc, row, at, flag, to = key[order], doc[order], row[order], at[order], flag[order], to[order]
        cuts = _groups(to)
        for a, b in zip(cuts, cuts[1:], strict=False):
            k = key[a:b].astype(np.int64)
            rows.append((int(to[a]), 1, pack(np.diff(k, prepend=0), doc[a:b], row[a:b], at[a:b] * 2 + flag[a:b])))
        for i in range(0, len(rows), 4096):
            yield _rows(rows[i : i + 4096])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        process_memory(None)
        held, size = [], 0
        for batch in batches:
            ids, which = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            data, offsets = _texts(batch.column(2))
            r, key, at, _, _ = _batched_anchors(data, offsets)
            held.append((key, ids[r], which[r], at))
            size += len(data)
            if size >= UNIT:
                yield from packed(held)
                held, size = [], 0
        if held:
            yield from packed(held)

    return run


def _met(targets: int):
    """(target, places) of the anchors that a bucket has from two documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, ("bucket", "kind")):
            if t["kind"][0].as_py() == 0:
                yield from t.to_batches()
                continue
            parts = [unpack(x, 4) for x in t["payload"].to_pylist()]
            key = np.concatenate([np.cumsum(p[0]) for p in parts])
            doc, row, at = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
            del parts
            flag, at = at & 1, at >> 1
            order = np.argsort(key, kind="stable")
            key, doc, row, at, flag = key[order], doc[order], row[order], at[order], flag[order]
            cuts = _groups(key)
            size = np.diff(cuts)
            real = flag == 0
            low = np.minimum.reduceat(np.where(real, doc, np.iinfo(np.int64).max), cuts[:-1])
            high = np.maximum.reduceat(np.where(real, doc, np.iinfo(np.int64).min), cuts[:-1])
            shared = np.repeat((np.add.reduceat(flag, cuts[:-1]) > 0) | (low < high), size) & real
            out = [(to, 0, blob) for to, blob in _per_target(targets, doc[shared], row[shared], at[shared])]
            # Frequent anchors: at most FREQUENT of a bucket, and the bucket's whole number of places.
            places = np.add.reduceat(np.where(real, 1, at), cuts[:-1])
            often = np.flatnonzero(places * FREQUENT >= places.sum())
            out.append((int(t["bucket"][0].as_py()), 2, pack(np.append(key[cuts[:-1][often]], -1), np.append(places[often], places.sum()))))
            yield _rows(out)

    return run


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n) of frequent anchors; -1 has the number of all places of a bucket."""
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            key, n = unpack(blob, 2)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])


def _hot(met: DataFrame, parts: int, least: int | None) -> frozenset[int]:
    """Anchors with more places than an even share of a partition (or ``least``). All places
    together make up the shares, so these are fewer than there are partitions."""
    found = met.where("kind = 2").select("payload").mapInArrow(_told, "key long, n long")
    if least is None:
        least = (found.where("key < 0").agg(F.sum("n")).first()[0] or 0) // parts + 1
    return frozenset(r["key"] for r in found.where((F.col("key") >= 0) & (F.col("n") >= least)).collect())


# --- steps 2 and 3: segments, suffix order, previous factors ---------------------------------


def _sent(buckets: int, targets: int, hot: frozenset[int]):
    """Segments around shared anchors, packed by bucket. Of equal ones the first document's goes on;
    the task's later documents are covered for certain (kind 0). A hot anchor's segments part into
    single strings that go by their own hash, so that its contexts spread over all buckets."""

    def packed(held: dict) -> Iterator[pa.RecordBatch]:
        covered: list[tuple[int, int, int, int]] = []
        out: dict[int, list] = {}
        for (key, content), seen in held.items():
            least = min(seen)[0]
            entries = out.setdefault(key % buckets, [])
            for doc, row, at in seen:
                if doc == least:
                    entries.append((key, doc, row, at, content))
                else:
                    covered.append((doc, row, at, at + len(content)))
        rows = []
        if covered:
            doc, row, a, b = (np.array(c, dtype=np.int64) for c in zip(*covered, strict=True))
            rows = [(t, 0, blob) for t, blob in _per_target(targets, doc, row, a, b)]
        for bucket, entries in out.items():
            key, doc, row, at = (np.array([e[i] for e in entries], dtype=np.int64) for i in range(4))
            size = np.array([len(e[4]) for e in entries], dtype=np.int64)
            head = pack(key, doc, row, at, size)
            body = pa.compress(b"".join(e[4] for e in entries), codec="zstd", asbytes=True)
            rows.append((bucket, 1, len(head).to_bytes(8, "little") + head + int(size.sum()).to_bytes(8, "little") + body))
        for i in range(0, len(rows), 2048):
            yield _rows(rows[i : i + 2048])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        process_memory(None)
        held: dict = {}
        size = 0
        for batch in batches:
            ids, which = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            data, offsets = _texts(batch.column(2))
            row, key, at, lo, hi = _batched_anchors(data, offsets)
            place = batch.column(3)
            cuts = np.searchsorted(row, np.arange(len(ids) + 1))
            whole = data.tobytes()
            for r in range(len(ids)):
                a, b = cuts[r], cuts[r + 1]
                if a == b:
                    continue
                wanted = _plains(place[r].as_py())[0]
                use = a + np.flatnonzero(np.isin(at[a:b], wanted))
                start, doc, me = int(offsets[r]), int(ids[r]), int(which[r])
                runs = zip(key[use].tolist(), lo[use].tolist(), hi[use].tolist(), strict=True)
                if hot:
                    runs = _parted(runs, hot, whole, start)
                for k, i, j in runs:
                    content = whole[start + i : start + j + WIDTH - 1]
                    entry = held.get((k, content))
                    if entry is None:
                        held[(k, content)] = [(doc, me, i)]
                        size += len(content) + 250
                    else:
                        entry.append((doc, me, i))
                        size += 80
            if size >= UNIT * 3:
                yield from packed(held)
                held, size = {}, 0
        if held:
            yield from packed(held)

    return run


def _parted(runs, hot: frozenset[int], text: bytes, start: int) -> Iterator[tuple[int, int, int]]:
    """(key, first window, end window) of runs; those of hot keys one window at a time."""
    for k, i, j in runs:
        if k in hot:
            for w in range(i, j):
                yield zlib.crc32(text[start + w : start + w + WIDTH]) | 1 << 44, w, w + 1
        else:
            yield k, i, j


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number in the order of the bytes; zeros follow the end."""
    out = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    for n in (1, 2, 4):
        out = out[:-n] << np.uint64(8 * n) | out[n:]
    return out


def suffix_order(words: np.ndarray, starts: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The suffixes at starts, sorted by their first width bytes; ties stay in their order.

    From the last digit to the first; a digit is a few bytes over the place in the order so far,
    so one sort of plain numbers is a stable pass. words: eights() of the text.
    """
    bits = next(b for b in (16, 24, 32) if len(starts) <= 1 << b)
    step, low = (64 - bits) // 8, np.uint64((1 << bits) - 1)
    order = np.arange(len(starts))
    place = np.arange(len(starts), dtype=np.uint64)
    for k in reversed([*range(0, width - step, step), max(width - step, 0)]):
        digit = words[starts[order] + k] & ~low
        if width - k < step:  # a width below one digit: what lies beyond it doesn't count
            digit &= np.uint64((1 << 64) - (1 << 64 - 8 * width))
        digit |= place
        digit.sort()
        order = order[(digit & low).astype(np.int64)]
    return order


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller value, or -1.

    Over a tree of minima: up to the first left neighbour that holds a smaller value, then down
    to the last such place in it; all places together, level by level.
    """
    n = len(values)
    trees = [values]
    top = np.iinfo(values.dtype).max
    while len(trees[-1]) > 1:
        t = trees[-1] if len(trees[-1]) % 2 == 0 else np.append(trees[-1], top)
        trees.append(np.minimum(t[::2], t[1::2]))
    out = np.full(n, -1, dtype=np.int64)
    active, at = np.arange(n), np.arange(n)
    found: list[np.ndarray] = []
    for t in trees:
        hit = (at & 1 == 1) & (t[at - 1] < values[active])
        found.append(active[hit])
        out[active[hit]] = at[hit] - 1
        active, at = active[~hit], at[~hit] >> 1
        if not len(active):
            break
    down = np.zeros(0, dtype=np.int64)
    for level in range(len(found) - 1, 0, -1):
        down = np.concatenate([down, found[level]])
        right, t = 2 * out[down] + 1, trees[level - 1]
        inside = right < len(t)
        use = inside & (t[np.where(inside, right, 0)] < values[down])
        out[down] = np.where(use, right, right - 1)
    return out


def common_prefixes(words: np.ndarray, one: np.ndarray, two: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """How many bytes the strings at two lists of places agree in, width at most."""
    out = np.full(len(one), width, dtype=np.int64)
    live = np.arange(len(one))
    for k in range(0, width, 8):
        x = words[one + k] ^ words[two + k]
        differs = x != 0
        if differs.any():
            ends, y = live[differs], x[differs]
            same = np.full(len(y), k, dtype=np.int64)
            for b in range(1, 8):
                same += y < np.uint64(1 << 8 * b)
            out[ends] = np.minimum(same, width)
            live, one, two = live[~differs], one[~differs], two[~differs]
    return out


def longest_previous_factors(data: np.ndarray, starts: np.ndarray, owner: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """For the string at each start: the length of the longest match with a string of a smaller
    owner, width at most, and which start that is (-1: none).

    Away from a suffix in suffix order matches only get shorter, so the longest one is with the
    nearest suffix of a smaller owner on either side. starts come in ascending order of owner.
    """
    words = eights(np.concatenate([data, np.zeros(width, np.uint8)]))
    order = suffix_order(words, starts, width)
    ranked = owner[order]
    before = previous_smaller(ranked)
    after = len(order) - 1 - previous_smaller(ranked[::-1])[::-1]
    length, source = np.zeros(len(order), dtype=np.int64), np.full(len(order), -1, dtype=np.int64)
    for side in (before, after):
        has = np.flatnonzero((side >= 0) & (side < len(order)) & (length[order] < width))
        mine, other = order[has], order[side[has]]
        match = common_prefixes(words, starts[mine], starts[other], width)
        better = match > length[mine]
        length[mine[better]], source[mine[better]] = match[better], other[better]
    return length, source


def _in_portions(entries: list[tuple], portions: int) -> list[tuple]:
    """Each pack's (cuts, doc, row, at, first byte, end byte, bytes), dealt to portions by anchor."""
    out = []
    for key, doc, row, at, size, body in entries:
        part = splitmix(key.view(np.uint64)) % np.uint64(portions)
        order, ends = np.argsort(part, kind="stable"), np.cumsum(size)
        out.append((np.searchsorted(part[order], np.arange(portions + 1)), *(c[order] for c in (doc, row, at, ends - size, ends)), body))
    return out


def _covered(dealt: list[tuple], part: int) -> list[tuple[int, int, int, int]]:
    """(doc, row, start, end) of covered runs of one portion of a bucket's segments. Equal strings
    have equal anchors, so portions don't need each other."""
    merged: dict[bytes, list] = {}
    for cuts, *columns, body in dealt:
        use = slice(cuts[part], cuts[part + 1])
        for d, r, i, a, b in zip(*(c[use].tolist() for c in columns), strict=True):
            merged.setdefault(body[a:b], []).append((d, r, i))
    # Each segment for its least document, and once more for all later ones: their factors are the same.
    text: list[tuple[int, bytes, list]] = []
    for content, seen in merged.items():
        least = min(seen)[0]
        text.append((least, content, [x for x in seen if x[0] == least]))
        if later := [x for x in seen if x[0] > least]:
            text.append((min(later)[0], content, later))
    del merged
    if len(text) < 2:
        return []
    text.sort(key=lambda x: x[0])
    data = np.frombuffer(b"".join(x[1] for x in text), dtype=np.uint8)
    size = np.array([len(x[1]) for x in text], dtype=np.int64)
    windows = size - WIDTH + 1
    begin = np.cumsum(size) - size
    which = np.repeat(np.arange(len(text)), windows)
    offset = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)
    owner = np.array([x[0] for x in text], dtype=np.int64)
    length, _ = longest_previous_factors(data, begin[which] + offset, owner[which])
    hit = length >= WIDTH
    # Runs of covered strings within a segment.
    edge = np.concatenate([[True], which[1:] != which[:-1], [True]])
    opens = np.flatnonzero(hit & (edge[:-1] | ~np.concatenate([[False], hit[:-1]])))
    closes = np.flatnonzero(hit & (edge[1:] | ~np.concatenate([hit[1:], [False]])))
    return [(d, r, i + a, i + b + WIDTH) for s, a, b in zip(which[opens].tolist(), offset[opens].tolist(), offset[closes].tolist(), strict=True) for d, r, i in text[s][2]]


def _factored(targets: int):
    """(target, runs) of covered bytes, from a bucket's segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, ("bucket", "kind")):
            if t["kind"][0].as_py() == 0:
                yield from t.to_batches()
                continue
            entries = []
            for blob in t["payload"].to_pylist():
                n = int.from_bytes(blob[:8], "little")
                key, doc, row, at, size = unpack(blob[8 : 8 + n], 5)
                total = int.from_bytes(blob[8 + n : 16 + n], "little")
                entries.append((key, doc, row, at, size, pa.decompress(blob[16 + n :], decompressed_size=total, codec="zstd", asbytes=True)))
            portions = sum(int((e[4] - WIDTH + 1).sum()) for e in entries) // PORTION + 1
            dealt = _in_portions(entries, portions)
            covered = [x for part in range(portions) for x in _covered(dealt, part)]
            if covered:
                doc, row, a, b = (np.array(c, dtype=np.int64) for c in zip(*covered, strict=True))
                yield _rows([(to, 0, blob) for to, blob in _per_target(targets, doc, row, a, b)])

    return run


# --- step 4: what remains --------------------------------------------------------------------


def merged_runs(blob: bytes | None, n: int) -> list[tuple[int, int]]:
    """Maximal covered runs within n bytes."""
    if not blob:
        return []
    a, b = _plains(blob)
    b = np.minimum(b, n)
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.concatenate([[True], a[1:] > b[:-1]])
    firsts = np.flatnonzero(new)
    return [(s, e) for s, e in zip(a[firsts].tolist(), b[np.append(firsts[1:], len(a)) - 1].tolist(), strict=True) if s < e]


def _rowed(docs: DataFrame) -> DataFrame:
    """doc_id (not null), row, text and the rest as a struct. row is 0, but a hash of the text where
    the id is null or comes more than once: it tells such rows apart."""
    more = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*more) if more else F.lit(None)
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), rest.alias("rest"))
    often = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    alone = F.col("doc_id").isNotNull()
    if not often.isEmpty():
        whole = whole.join(often, "doc_id", "left")
        alone = alone & F.col("n").isNull()
    return whole.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc_id"), F.when(alone, F.lit(0).cast("long")).otherwise(F.xxhash64("text")).alias("row"), "text", "rest")


def with_runs(docs: DataFrame, hot: int | None = None) -> DataFrame:
    """doc_id, row, text, runs (packed covered runs, null where there are none) and the rest as a struct.

    hot: places from which an anchor counts as hot; by default an even share of a partition.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART))
    whole = _rowed(docs)
    dealt = whole.repartition(parts, "doc_id", "row")
    by_bucket = lambda df: df.repartitionById(parts, "bucket").sortWithinPartitions("bucket", "kind")
    met = stored(by_bucket(whole.select("doc_id", "row", "text").mapInArrow(_offered(parts, parts), _ROWS)).mapInArrow(_met(parts), _ROWS), "places")
    often = _hot(met, parts, hot)
    places = by_bucket(met.where("kind = 0")).mapInArrow(_by_doc(1), _BY_DOC).withColumnRenamed("payload", "places")
    sent = dealt.join(places, ["doc_id", "row"]).select("doc_id", "row", "text", "places", "rest").mapInArrow(_sent(parts, parts, often), _ROWS)
    found = by_bucket(sent).mapInArrow(_factored(parts), _ROWS)
    runs = by_bucket(found).mapInArrow(_by_doc(2), _BY_DOC).withColumnRenamed("payload", "runs")
    return dealt.join(runs, ["doc_id", "row"], "left").select("doc_id", "row", "text", "runs", "rest")


_DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def digests(docs: DataFrame, hot: int | None = None) -> DataFrame:
    """doc_id, bytes, removed bytes, removed runs and the SHA-256 of what remains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for doc, text, blobs in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                data = (text or "").encode()
                spans, at, kept = merged_runs(blobs, len(data)), 0, hashlib.sha256()
                for a, b in spans:
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                for o, v in zip(out, (None if doc == _NO_ID else doc, len(data), sum(b - a for a, b in spans), len(spans), kept.hexdigest()), strict=True):
                    o.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return with_runs(docs.select("doc_id", "text"), hot).mapInArrow(run, _DIGEST)


def cut_text(text: str | None, blob: bytes | None) -> str | None:
    """The text without its covered runs; a run gives back bytes of characters that it covers in part."""
    if text is None or not blob:
        return text
    data = text.encode()
    out, at = [], 0
    for a, b in merged_runs(blob, len(data)):
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        out.append(data[at:a])
        at = max(at, b)
    out.append(data[at:])
    return b"".join(out).decode()


def without_repeats(docs: DataFrame, hot: int | None = None) -> DataFrame:
    """The rows of docs with all their columns, texts without what an earlier document has."""
    rows = with_runs(docs, hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [cut_text(t, r) for t, r in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), batch.column("rest")], names=["doc_id", "text", "rest"])

    # In one step over all columns: what callers prune later can't part the two uses of the exchange.
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    none = kinds["rest"] == "void"
    rows = rows.select("doc_id", "text", "runs", F.lit(0).alias("rest") if none else "rest")
    cut = rows.mapInArrow(run, f"doc_id long, text string, rest {'int' if none else kinds['rest']}")
    own = {"doc_id": F.nullif("doc_id", F.lit(_NO_ID)), "text": F.col("text")}
    return cut.select(*[own[c].alias(c) if c in own else F.col("rest")[c].alias(c) for c in docs.columns])


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))


#: Strings as hex digits; texts are cut in two steps, as a place in a long text takes time to find.
OP9_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, c, substr(h, 512 * c + 1, 610) AS s, length(h) // 2 - 50 AS most FROM (SELECT doc_id, h, unnest(generate_series(0, (length(h) // 2 - 50) // 256)) AS c FROM d WHERE length(h) >= 100)),
w AS (SELECT doc_id, 256 * c + k AS i, substr(s, 2 * k + 1, 100) AS s FROM (SELECT doc_id, c, s, unnest(generate_series(0, least(255, most - 256 * c))) AS k FROM p)),
m AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM w) WHERE least < doc_id),
o AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, true) AS opens FROM m),
r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT doc_id, i, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o) GROUP BY doc_id, run),
k AS (SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS a, a AS b FROM r
      UNION ALL SELECT d.doc_id, coalesce(max(r.b), 0), length(any_value(h)) // 2 FROM d LEFT JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id),
t AS (SELECT k.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS h FROM k JOIN d ON d.doc_id = k.doc_id GROUP BY k.doc_id),
n AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(t.h)) AS kept_sha256
FROM d JOIN t ON t.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
