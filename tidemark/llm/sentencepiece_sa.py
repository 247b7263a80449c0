"""SentencePiece encoding and decoding by suffix-array matching.

The new words of a batch are concatenated and their suffixes sorted. A binary search of every
piece gives its range in suffix order, that is, all its occurrences at once; these are the edges
of a graph over text positions. Edges are sorted by position and relaxed: each reachable position
keeps the token that ends there. The model merges pairs by rank (BPE), so no sum of scores
decides: a token may follow another exactly if the two stay apart when their own text is
encoded, and then at most one token can end a prefix. Characters that no piece has become bytes.

Words (white space in front included) are independent, as no piece spans the end of one; what a
process has encoded it remembers. A few words have a run of spaces, whose pieces tie in rank;
they are merged directly, leftmost first.

Defined cases: a null or empty text has no ids and decodes to the empty string; a word joiner
sign (U+2581) in a text encodes as a space does, as the model has it, so it decodes to one;
rows are encoded one by one; texts and words may have any length.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import process_memory, read

MODEL = "piece_bpe_32k.model"
#: Words that a process remembers, and bytes of new words that are indexed at a time.
MEMORY, INDEX = 600_000, 1 << 20
SPACE = "▁"


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def codec(path: str) -> Codec:
    """One per process and file."""
    held = process_memory("sentencepiece")
    if path not in held:
        held[path] = Codec(path)
    return held[path]


def suffix_array(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes in the order of their first 16 bytes, and these bytes as two big-endian words."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(data) + 8].copy().view(">u8").ravel().astype(np.uint64)
    one, two = words[: len(data)], words[8 : len(data) + 8]
    order = np.argsort(two, kind="stable")
    order = order[np.argsort(one[order], kind="stable")]
    return order, one[order], two[order]


class Codec:
    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        if n > 1 << 16 or sp.normalize(" Ａb  ﬁ ") != SPACE + " Ａb  ﬁ ".replace(" ", SPACE):
            raise ValueError("only models that leave the text as it is, with a space in front, are supported")
        self.unknown = sp.unk_id()
        self.byte_ids = np.zeros(256, dtype="<u2")
        self.raw: list[bytes] = []
        self.rank: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.raw.append(b"")
            else:
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError("a piece spans the end of a word")
                self.ids[piece], self.rank[piece] = i, sp.get_score(i)
                self.raw.append(piece.replace(SPACE, " ").encode())
        self.texts = {i: p for p, i in self.ids.items()}
        # A line break that no piece has parts words as well.
        parts = r"\n|" if not any("\n" in p for p in self.ids) else ""
        rest = r"[^▁\n]" if parts else r"[^▁]"
        self.words = re.compile(rf"{parts}▁+{rest}*|{rest}+").findall
        self.known: dict[str, bytes] = {}
        self.apart: dict[int, bool] = {}
        self._index()

    def _index(self) -> None:
        """Pieces as byte keys for the search: bounds of their first and second eight bytes."""
        items = sorted((p.encode(), i) for p, i in self.ids.items() if not p.startswith(SPACE * 2))
        self.piece_bytes = [b for b, _ in items]
        self.piece_ids = np.array([i for _, i in items], dtype=np.int64)
        self.piece_len = np.array([len(b) for b in self.piece_bytes], dtype=np.int64)
        bound = lambda part, fill: np.array([int.from_bytes(part(b).ljust(8, fill)[:8], "big") for b in self.piece_bytes], dtype=np.uint64)
        self.low1, self.high1 = bound(lambda b: b[:8], b"\0"), bound(lambda b: b[:8], b"\xff")
        self.low2, self.high2 = bound(lambda b: b[8:16], b"\0"), bound(lambda b: b[8:16], b"\xff")

    # --- merges of one word, for pairs and for runs of spaces ---

    def merged(self, text: str) -> list[str]:
        """Symbols after all merges, best rank first, leftmost among equals."""
        n = len(text)
        symbol, after, before = list(text), [*range(1, n), -1], [*range(-1, n - 1)]
        heap: list[tuple[float, int, str, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (r := self.rank.get(symbol[i] + symbol[j])) is not None:
                heapq.heappush(heap, (-r, i, symbol[i] + symbol[j], j))

        for i in range(n):
            offer(i)
        while heap:
            _, i, whole, j = heapq.heappop(heap)
            if not symbol[i] or after[i] != j or symbol[i] + symbol[j] != whole:
                continue
            symbol[i], symbol[j] = whole, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [s for s in symbol if s]

    def _stay_apart(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens is the encoding of its own text."""
        keys, back = np.unique(one << 16 | two, return_inverse=True)
        out = np.empty(len(keys), dtype=bool)
        apart, texts, unknown = self.apart, self.texts, self.unknown
        for k, key in enumerate(keys.tolist()):
            got = apart.get(key)
            if got is None:
                a, b = key >> 16, key & 0xFFFF
                got = apart[key] = a == unknown or b == unknown or self.merged(texts[a] + texts[b]) == [texts[a], texts[b]]
            out[k] = got
        return out[back.ravel()]

    # --- a batch of new words ---

    def _occurrences(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and id of every occurrence of every piece."""
        order, one, two = suffix_array(data)
        lo, hi = np.searchsorted(one, self.low1, "left"), np.searchsorted(one, self.high1, "right")
        long = np.flatnonzero((self.piece_len > 8) & (lo < hi))
        for k in long.tolist():
            part = two[lo[k] : hi[k]]
            lo[k], hi[k] = lo[k] + np.searchsorted(part, self.low2[k], "left"), lo[k] + np.searchsorted(part, self.high2[k], "right")
        count = hi - lo
        starts = np.repeat(np.cumsum(count) - count, count)
        place = order[np.repeat(lo, count) + np.arange(int(count.sum())) - starts]
        which = np.repeat(np.arange(len(lo)), count)
        size = self.piece_len[which]
        rest = np.flatnonzero(size > 16)  # beyond the sorted depth: compare the bytes
        if len(rest):
            raw = data.tobytes()
            good = np.array([raw[p : p + n] == self.piece_bytes[w] for p, n, w in zip(place[rest].tolist(), size[rest].tolist(), which[rest].tolist(), strict=True)], dtype=bool)
            keep = np.ones(len(place), dtype=bool)
            keep[rest[~good]] = False
            place, size, which = place[keep], size[keep], which[keep]
        return place, size, self.piece_ids[which]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        raw = [w.encode() for w in words]
        size = np.array([len(w) for w in raw], dtype=np.int64)
        data = np.frombuffer(b"\0".join([*raw, b""]), dtype=np.uint8)
        begin = np.cumsum(size + 1) - size - 1
        place, length, token = self._occurrences(data)
        # Characters without a piece of their own: one edge each.
        head = (data & 0xC0) != 0x80
        ends = np.flatnonzero(np.append(head[1:], True)) + 1
        char_at = np.flatnonzero(head)
        char_len = ends - char_at
        single = np.zeros(len(data) + 1, dtype=np.int64)
        np.maximum.at(single, place, np.where(char_len[np.searchsorted(char_at, place)] == length, 1, 0))
        lone = np.flatnonzero(single[char_at] == 0)
        lone = lone[char_at[lone] < len(data)]
        owner = np.searchsorted(begin, char_at[lone], side="right") - 1
        lone = lone[char_at[lone] < begin[owner] + size[owner]]  # not the separators
        place = np.concatenate([place, char_at[lone]])
        length = np.concatenate([length, char_len[lone]])
        token = np.concatenate([token, np.full(len(lone), self.unknown, dtype=np.int64)])
        # No merge crosses a place that no piece spans, so words part there; steps are as many as the longest part has.
        spans = np.cumsum(np.bincount(place + 1, minlength=len(data) + 1) - np.bincount(place + length, minlength=len(data) + 1))
        part = np.flatnonzero(spans[: len(data)] == 0)
        owner = np.searchsorted(begin, part, side="right") - 1
        inside = part < begin[owner] + size[owner]  # not the separators
        part, owner = part[inside], owner[inside]
        step = place - part[np.searchsorted(part, place, side="right") - 1]
        order = np.argsort(step, kind="stable")
        place, length, token, step = place[order], length[order], token[order], step[order]
        last, origin = np.full(len(data) + 1, -1, dtype=np.int64), np.zeros(len(data) + 1, dtype=np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], step[1:] != step[:-1], [True]])) if len(step) else []
        for a, b in zip(cuts, cuts[1:], strict=False):
            p, t, n = place[a:b], token[a:b], length[a:b]
            if step[a]:
                ends_here = last[p]
                use = np.flatnonzero(ends_here >= 0)
                use = use[self._stay_apart(ends_here[use], t[use])]
                p, t, n = p[use], t[use], n[use]
            last[p + n], origin[p + n] = t, p
        # Back from each part's end, all parts at a time.
        at, found = np.minimum(np.append(part[1:], len(data)), begin[owner] + size[owner]), []
        live = np.arange(len(part))
        while len(live):
            here = at[live]
            found.append((origin[here], last[here]))
            at[live] = origin[here]
            live = live[at[live] > part[live]]
        where, ids = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        order = np.argsort(where, kind="stable")
        where, ids = where[order], ids[order]
        if (ids < 0).any():
            raise RuntimeError("a word has no encoding")
        many = np.ones(len(ids), dtype=np.int64)
        odd = ids == self.unknown
        many[odd] = char_len[np.searchsorted(char_at, where[odd])]
        out = np.repeat(ids, many)
        first = np.cumsum(many) - many
        spot = np.flatnonzero(np.repeat(odd, many))
        out[spot] = self.byte_ids[data[np.repeat(where, many)[spot] + spot - np.repeat(first, many)[spot]]]
        whole = out.astype("<u2").tobytes()
        stops = np.append(first, len(out))[np.searchsorted(where, np.append(begin, len(data)))] * 2
        return [whole[a:b] for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]

    def learn(self, words: list[str]) -> None:
        plain, at = [], 0
        for w in words:
            if w.startswith(SPACE * 2):
                ids = [[self.ids[s]] if s in self.ids else self.byte_ids[list(s.encode())].tolist() for s in self.merged(w)]
                self.known[w] = np.array([i for part in ids for i in part], dtype="<u2").tobytes()
            else:
                plain.append(w)
                at += len(w)
                if at >= INDEX:
                    self.known.update(zip(plain, self._encode_words(plain), strict=True))
                    plain, at = [], 0
        if plain:
            self.known.update(zip(plain, self._encode_words(plain), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as unsigned 16-bit little-endian numbers."""
        parts = [self.words(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        fresh = set().union(*parts).difference(self.known)
        if len(self.known) + len(fresh) > MEMORY:
            self.known.clear()
            fresh = set().union(*parts)
        if fresh:
            self.learn(sorted(fresh))
        return [b"".join(map(self.known.__getitem__, p)) for p in parts]

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that aren't UTF-8 become replacement signs."""
        raw = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, dtype="<u2").tolist()))
        return raw.decode("utf-8", "replace").removeprefix(" ")


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (array<int>) of each document. No shuffle."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = one.encode([t or "" for t in part.column(1).to_pylist()])
                cuts = np.concatenate([[0], np.cumsum([len(x) // 2 for x in ids])]).astype(np.int32)
                flat = np.frombuffer(b"".join(ids), dtype="<u2").astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows with ids."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(path)
        for batch in batches:
            texts = [one.decode(np.array(x or [], dtype="<u2").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


_DIGEST = "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean"


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Number and CRC-32 of the ids (as 32-bit numbers), the decoded text's SHA-256, and whether it is the text."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = one.encode(texts)
                back = [one.decode(x) for x in ids]
                columns = [
                    part.column(0), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array([zlib.crc32(np.frombuffer(x, dtype="<u2").astype("<u4").tobytes()) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back]), pa.array([a == b for a, b in zip(texts, back, strict=True)], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _DIGEST.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _DIGEST)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))
