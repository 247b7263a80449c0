"""Concatenate and cut: documents as one token stream, cut into windows of a fixed length.

Pass 1 tokenises each partition once, writes the ids and keeps a running sum of tokens within
the partition. The partitions' totals (one number each) give prefix sums, so every document
has its global offset without a sort or a shuffle. Pass 2 reads the ids, and cuts each document
where windows begin; a document that crosses a boundary leaves one record on each side. Only
the last window can be short, so no more than one sequence has padding.

Ids come from a public tokenizer file, END follows each document. The tokenizer never joins
characters across white space, so each distinct word of a portion of texts is encoded once, in bulk,
as letters and the marks after them, and numpy puts the ids in the words' order. Plain Latin letters
skip the tokenizer's normalizer and pattern, which change nothing in them.

Defined cases: a null text is empty and has END alone; documents of any length span as many
windows as they need; repeated rows and ids are packed one by one; an empty table has no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import process_memory, read, stored

LENGTH, END = 2048, 1
TOKENIZER = "word_bpe_49k.json"
#: Bytes of text that are encoded at a time; a longer single text is taken whole.
PORTION = 1 << 25
#: Marks that the tokenizer parts from letters before them and takes as one run.
MARKS = ".,!?;:|#*$%&"
#: Encodes texts: all their ids as unsigned 16-bit numbers, and each text's number of these.
Encoder = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """A function from texts to their ids as unsigned 16-bit little-endian numbers."""

    def encode(texts: list[str]) -> list[bytes]:
        ids, n = array_encoder(path)(pa.array(texts, pa.string()))
        cuts = (2 * np.cumsum(n)).tolist()
        return [ids.tobytes()[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]

    return encode


def array_encoder(path: str) -> Encoder:
    """One per process and file: tasks that follow one another in a worker share the tokenizer."""
    held = process_memory("packing")
    if path not in held:
        held[path] = _encoder(path)
    return held[path]


def _gathered(ids: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The runs of n ids from start, one after the other."""
    at = np.repeat(start - (np.cumsum(n) - n), n)
    at += np.arange(len(at))
    return ids[at]


def _encoder(path: str) -> Encoder:
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    tok, latin = Tokenizer.from_file(path), Tokenizer.from_file(path)
    if tok.get_vocab_size() > 1 << 16:
        raise ValueError("ids don't fit 16 bits")
    latin.normalizer = normalizers.Sequence([])
    latin.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    ends = np.zeros(tok.get_vocab_size(), dtype=bool)
    for piece, i in tok.get_vocab().items():
        ends[i] = piece.endswith("</w>")

    def singly(words: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u2") for at in range(0, len(words), 512) for e in tok.encode_batch_fast(words[at : at + 512], add_special_tokens=False)]

    def in_bulk(words: list[str], by: Tokenizer) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(0, len(words), 512):
            part = words[at : at + 512]
            ids = np.array(by.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u2")
            cuts = np.flatnonzero(ends[ids]) + 1
            if len(cuts) == len(part):
                yield ids, np.diff(cuts, prepend=0)
            else:  # some word made several tokens' worth: each for itself
                yield _joined(singly(part))

    def of_words(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where each word's begin and how many it has."""
        lower = pc.utf8_lower(words)
        letters = pc.utf8_rtrim(lower, characters=MARKS)
        # To the tokenizer İ is two characters in lower case.
        plain = pc.and_(pc.utf8_is_alpha(letters), pc.invert(pc.match_substring(words, "İ")))
        is_plain = plain.to_numpy(zero_copy_only=False)
        core = letters.filter(plain).dictionary_encode()
        tail = _rest(lower.filter(plain), letters.filter(plain)).dictionary_encode()
        is_latin = pc.match_substring_regex(core.dictionary, "^[a-zß-öø-ÿ]+$")
        fast, slow = core.dictionary.filter(is_latin), core.dictionary.filter(pc.invert(is_latin))
        odd = words.filter(pc.invert(plain)).to_pylist()
        parts = [*in_bulk(fast.to_pylist(), latin), *in_bulk(slow.to_pylist(), tok), _joined(singly(tail.dictionary.to_pylist())), _joined(singly(odd))]
        ids, n = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
        start = np.cumsum(n) - n
        quick = is_latin.to_numpy(zero_copy_only=False)
        place = np.empty(len(quick), dtype=np.int64)  # of each core among the parts
        place[quick], place[~quick] = np.arange(len(fast)), len(fast) + np.arange(len(slow))
        pair = np.column_stack([place[core.indices.to_numpy()], len(quick) + tail.indices.to_numpy()]).ravel()
        both, sizes = _gathered(ids, start[pair], n[pair]), n[pair].reshape(-1, 2).sum(axis=1)
        own = len(n) - len(odd)
        begin, size = np.empty(len(words), dtype=np.int64), np.empty(len(words), dtype=np.int64)
        begin[is_plain], size[is_plain] = len(ids) + np.cumsum(sizes) - sizes, sizes
        begin[~is_plain], size[~is_plain] = start[own:], n[own:]
        return np.concatenate([ids, both]), begin, size

    def ids_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts):
            return np.zeros(0, "<u2"), np.zeros(0, np.int64)
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        ids, begin, size = of_words(words.dictionary)
        at = words.indices.to_numpy()
        n = size[at]
        sums = np.concatenate([[0], np.cumsum(n)])[lists.offsets.to_numpy()]
        return _gathered(ids, begin[at], n), np.diff(sums)

    return ids_of


def _rest(whole: pa.Array, begin: pa.Array) -> pa.Array:
    """What follows in each string of whole after its beginning."""
    if not len(whole):
        return whole
    low, n = np.frombuffer(whole.buffers()[1], dtype=np.int32)[whole.offset : whole.offset + len(whole) + 1].astype(np.int64), pc.binary_length(begin).to_numpy()
    size = np.diff(low) - n
    rest = _gathered(np.frombuffer(whole.buffers()[2], dtype=np.uint8), low[:-1] + n, size)
    return pa.Array.from_buffers(pa.string(), len(whole), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(rest)])


def _joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.zeros(0, "<u2"), *parts]), np.array([len(x) for x in parts], dtype=np.int64)


_TOKENS = "doc_id long, part int, start long, n long, ids binary"
_TOKENS_ARROW = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("start", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, part (the task), start (tokens before it in the part), n and the ids with END."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, ids_of = TaskContext.get().partitionId(), 0, array_encoder(path)
        for batch in batches:
            texts = batch.column(1).fill_null("")
            so_far, lo = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)), 0
            while lo < len(texts):
                before = so_far[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(so_far, before + PORTION, side="right")))
                ids, n = ids_of(texts.slice(lo, hi - lo))
                ids, n = np.insert(ids, np.cumsum(n), END), n + 1
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.concatenate([[0], 2 * np.cumsum(n)])), pa.py_buffer(ids)])
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(np.full(len(n), part, np.int32)), pa.array(starts), pa.array(n), blobs.cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=_TOKENS_ARROW)
                lo = hi

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _TOKENS)


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [c.split()[0] for c in _PIECES.split(", ")]


def pieces(tokens: DataFrame, length: int = LENGTH) -> DataFrame:
    """The pieces of stored tokens: one record per document and window that it touches.

    The partitions' totals, one row each, are summed up in order and broadcast: 16 bytes for each
    task that wrote tokens, fewer than the scheduler itself keeps for it.
    """
    totals = tokens.groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("base"))
    placed = tokens.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("start")).alias("origin"), "n", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in _NAMES]
            for doc, origin, n, blob in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                ids = np.frombuffer(blob, dtype="<u2").astype("<u4")
                at = 0
                while at < n:
                    sequence, offset = divmod(origin + at, length)
                    size = min(length - offset, n - at)
                    for o, v in zip(out, (doc, at, size, zlib.crc32(ids[at : at + size].tobytes()), n, sequence, offset), strict=True):
                        o.append(v)
                    at += size
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=_NAMES)

    return placed.mapInArrow(run, _PIECES)


def packed(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    return pieces(stored(tokenized(docs, path or tokenizer_path()), "tokens"), length)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read(spark, sf_dir, "documents"))
