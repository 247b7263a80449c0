"""Toxic spans by a linear-chain conditional random field; document scores from its marginals.

Labels exist for documents only. Words and word beginnings that mark toxic documents in many
contexts and hardly occur in clean ones label the tokens of toxic documents; the field learns
from these tokens and their surroundings (hashed features of the word, two labels, transitions).
Forward-backward gives each token's probability of being toxic; a document's score is a logistic
function of their sum and maximum, fitted on the same sample, and tokens of 0.5 or more are the
offending spans.

Fitting takes a bounded sample: SAMPLE labelled ids of each label, the first by a hash of the id,
as far as their whole texts come to BYTES, texts of more than ROW_BYTES aside, so neither rows nor
bytes grow with the corpus. Long texts belong in it: they hold most of the clean words that look
like markers. The field's sequences are the surroundings (REACH) of the first HITS marked tokens of each
sampled document, and of RANDOM other tokens of clean ones; the document score is fitted on whole
sampled texts. One task fits, so the driver gets the weights (1 MB) and no text.
Scoring covers every text whole, in one pass without a shuffle. Texts are
cut into stretches of STRETCH tokens that overlap by WARM; the chain forgets geometrically, so
this equals one long pass to within rounding.

Defined cases: null and empty texts have no tokens and get the score of a sum of 0; rows with
equal ids are scored one by one; of rows with one labelled id the least text trains, an id with both labels doesn't; without any labelled row of either kind the score is 0.5 less
one part in a thousand for all; other columns are never inputs of a score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from .common import process_memory, read

#: Labelled rows that fitting may use: clean, toxic.
SAMPLE = (6000, 3000)
#: Bytes of one labelled text that fitting may use, and of all texts of a label: clean, toxic.
ROW_BYTES, BYTES = 1 << 20, (1 << 26, 1 << 25)
#: Sequences for fitting: tokens on either side, marked tokens of a document, random tokens of a clean one.
REACH, HITS, RANDOM = 8, 6, 2
#: Hashed features, tokens of a stretch, overlap, words that a task remembers.
DIM, STRETCH, WARM, MEMORY = 1 << 18, 2048, 64, 400_000
#: A marker: log-odds of a feature between toxic and clean documents, and contexts it is seen in.
ODDS, CONTEXTS = 3.5, 5
_FIELD = "weight binary, bias double, move array<double>, document array<double>"
_EDGE = b" \t\n\x0b\x0c\r.,;:!?\"'()[]{}|*#$%&<>-_"


def normal(word: bytes) -> str:
    return word.decode("utf-8", "ignore").lower().strip(_EDGE.decode())


def features(word: str) -> tuple[str, ...]:
    """The word and its beginnings; those of fewer letters than the beginning has are the word."""
    return ("w" + word, "4" + word[:4], "5" + word[:5], "6" + word[:6])


def codes(word: str) -> list[int]:
    """A number of 32 bits for each feature; its low bits are the feature's place in the weights."""
    return [zlib.crc32(f.encode()) for f in features(word)]


class Field:
    """Weights of the field and of the document score. Scores are log-odds of toxic to clean."""

    def __init__(self) -> None:
        self.weight, self.bias = np.zeros(DIM, dtype=np.float32), -4.0
        self.move = np.zeros((2, 2))  # log-potential of label i followed by label j
        self.document = np.array([-2.0, 0.0, 0.0])

    def told(self) -> pa.RecordBatch:
        """One row of the schema _FIELD."""
        lists = [pa.array([x.ravel().tolist()], pa.list_(pa.float64())) for x in (self.move, self.document)]
        return pa.RecordBatch.from_arrays([pa.array([self.weight.tobytes()], pa.binary()), pa.array([float(self.bias)]), *lists], names=["weight", "bias", "move", "document"])

    @classmethod
    def of(cls, row: Row) -> Field:
        """The field that told() gave."""
        field = cls()
        field.weight, field.bias = np.frombuffer(bytes(row["weight"]), dtype=np.float32), row["bias"]
        field.move, field.document = np.array(row["move"]).reshape(2, 2), np.array(row["document"])
        return field

    def emission(self, word: str) -> float:
        return float(self.weight[[c & (DIM - 1) for c in codes(word)]].sum()) + self.bias

    def marginals(self, odds: np.ndarray, length: np.ndarray | None = None) -> np.ndarray:
        """odds: (time, sequences) emission log-odds; a column ends at its own length."""
        m, height = self.move, len(odds)
        length = np.full(odds.shape[1], height) if length is None else length
        # Messages are log-odds of the labels: what a neighbour's log-odds x say through the transitions w.
        step = lambda x, w: np.logaddexp(w[0, 1], w[1, 1] + x) - np.logaddexp(w[0, 0], w[1, 0] + x)
        out = np.empty_like(odds)
        out[0] = odds[0]
        for t in range(1, height):
            out[t] = odds[t] + step(out[t - 1], m)
        back = np.zeros(odds.shape[1])
        for t in range(height - 2, -1, -1):
            back = np.where(t + 1 < length, step(back + odds[t + 1], m.T), 0.0)
            out[t] += back
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))

    def score(self, total: np.ndarray, most: np.ndarray) -> np.ndarray:
        w = self.document
        return 1 / (1 + np.exp(-np.clip(w[0] + w[1] * np.log1p(total) + w[2] * most, -60, 60)))


def tagged(field: Field, odds: list[np.ndarray]) -> list[np.ndarray]:
    """Marginals of each sequence of emission log-odds."""
    parts = [(i, a, min(len(x), a + STRETCH)) for i, x in enumerate(odds) for a in range(0, max(1, len(x)), STRETCH) if len(x)]
    parts = sorted(((i, max(0, a - WARM), a, b, min(len(odds[i]), b + WARM)) for i, a, b in parts), key=lambda p: p[4] - p[1])
    out = [np.zeros(len(x)) for x in odds]
    for k in range(0, len(parts), 256):
        group = parts[k : k + 256]
        height = max(p[4] - p[1] for p in group)
        table = np.zeros((height, len(group)))
        for c, (i, lo, _, _, hi) in enumerate(group):
            table[: hi - lo, c] = odds[i][lo:hi]
        marked = field.marginals(table, np.array([p[4] - p[1] for p in group]))
        for c, (i, lo, a, b, _) in enumerate(group):
            out[i][a:b] = marked[a - lo : b - lo, c]
    return out


# --- fitting --------------------------------------------------------------------------------


def _markers(docs: list[np.ndarray], toxic: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Codes of the features that mark toxic documents. docs: word numbers; table: codes of each word."""
    counts = []
    for y in (0, 1):
        seen = [np.unique(table[np.unique(d)]) for d, label in zip(docs, toxic, strict=True) if label == y and len(d)]
        counts.append(np.unique(np.concatenate(seen or [np.zeros(0, table.dtype)]), return_counts=True))
    (clean, n_clean), (code, n_toxic) = counts
    at = np.searchsorted(clean, code)
    at[at == len(clean)] = 0
    also = np.where(clean[at] == code, n_clean[at], 0) if len(clean) else np.zeros(len(code))
    odds = np.log((n_toxic + 0.5) / max(1, toxic.sum())) - np.log((also + 0.5) / max(1, (1 - toxic).sum()))
    likely = code[(n_toxic >= CONTEXTS) & (odds >= ODDS)]
    # Contexts: the words that come before. Copies of one document share them and count once.
    pairs = [np.zeros((0, 2), dtype=np.int64)]
    for d, label in zip(docs, toxic, strict=True):
        if label and len(d):
            row, col = np.nonzero(np.isin(table[d], likely))
            before = np.where(row > 0, d[row - 1], -1)
            pairs.append(np.unique(np.column_stack([table[d[row], col], before]).astype(np.int64), axis=0))
    found, n = np.unique(np.unique(np.concatenate(pairs), axis=0)[:, 0], return_counts=True)
    return found[n >= CONTEXTS].astype(table.dtype)


def fit(texts: Iterable[str | None], labels: list[int], rounds: int = 80, seed: int = 7) -> Field:
    """A field from whole texts and their labels."""
    field, rng = Field(), np.random.default_rng(seed)
    toxic = np.array(labels, dtype=np.int64)
    if not len(toxic) or toxic.min() == toxic.max():
        field.bias, field.document = -30.0, np.array([-0.002, 0.0, 0.0])
        return field
    number: dict[str, int] = {}
    raw: dict[bytes, int] = {}
    docs = []
    for t in texts:  # words as numbers: a few bytes for each token of the sample
        for w in set((t or "").encode().split()).difference(raw):
            raw[w] = number.setdefault(normal(w), len(number))
        docs.append(np.fromiter(map(raw.__getitem__, (t or "").encode().split()), dtype=np.int32))
    del raw
    table = np.fromiter((c for w in number for c in codes(w)), dtype=np.uint32, count=4 * len(number)).reshape(-1, 4)
    marks = _markers(docs, toxic, table)
    marked = np.isin(table, marks).any(axis=1)
    if "" in number:
        marked[number[""]] = False
    del number
    reach, sequences = REACH, []
    for d, y in zip(docs, toxic, strict=True):
        hit = marked[d] if len(d) else np.zeros(0, dtype=bool)
        # In clean documents what looks like a marker is the most telling counterexample.
        spots = np.flatnonzero(hit)[:HITS].tolist()
        if not y and len(d):
            spots += rng.integers(0, len(d), size=RANDOM).tolist()
        for i in spots:
            lo, hi = max(0, i - reach), min(len(d), i + reach + 1)
            sequences.append((table[d[lo:hi]] & (DIM - 1), hit[lo:hi] & bool(y)))
    if not sequences:
        return field
    height = 2 * reach + 1
    ids = np.zeros((height, len(sequences), 4), dtype=np.int32)
    y = np.zeros((height, len(sequences)), dtype=np.int8)
    length = np.array([len(s[1]) for s in sequences])
    for c, (f, lab) in enumerate(sequences):
        ids[: len(lab), c], y[: len(lab), c] = f, lab
    _ascend(field, ids, y, length, rounds)
    # The document score: logistic regression on the marginals' sum and maximum.
    emissions = field.weight[table & (DIM - 1)].sum(axis=1).astype(np.float64) + field.bias
    total, most = np.zeros(len(docs)), np.zeros(len(docs))
    for at in range(0, len(docs), 512):
        for k, v in enumerate(tagged(field, [emissions[d] for d in docs[at : at + 512]]), at):
            total[k], most[k] = v.sum(), v.max() if len(v) else 0.0
    x = np.column_stack([np.ones(len(docs)), np.log1p(total), most])
    w = np.zeros(3)
    for _ in range(40):
        q = 1 / (1 + np.exp(-x @ w))
        h = (x * (q * (1 - q))[:, None]).T @ x + 0.05 * np.eye(3)
        w = w + np.linalg.solve(h, x.T @ (toxic - q) - 0.05 * w)
    field.document = w
    return field


def _ascend(field: Field, ids: np.ndarray, y: np.ndarray, length: np.ndarray, rounds: int) -> None:
    """AdaGrad on the conditional log-likelihood of the sequences."""
    height, n, _ = ids.shape
    mask = np.arange(height)[:, None] < length[None, :]
    pair_mask = mask[1:]
    weight = np.zeros(DIM)
    sq_w, sq_b, sq_m = np.full(DIM, 1e-6), 1e-6, np.full((2, 2), 1e-6)
    flat = ids[mask].ravel()
    for _ in range(rounds):
        e = weight[ids].sum(axis=2) + field.bias
        m = field.move
        node = np.zeros((height, n, 2))
        node[..., 1] = np.where(mask, e, 0)
        fwd, bwd = np.zeros_like(node), np.zeros_like(node)
        fwd[0] = node[0]
        for t in range(1, height):
            new = node[t] + np.logaddexp(fwd[t - 1][:, :1] + m[0], fwd[t - 1][:, 1:] + m[1])
            fwd[t] = np.where(mask[t][:, None], new, fwd[t - 1])
        for t in range(height - 2, -1, -1):
            nxt = node[t + 1] + bwd[t + 1]
            new = np.logaddexp(m[:, 0] + nxt[:, :1], m[:, 1] + nxt[:, 1:])
            bwd[t] = np.where(pair_mask[t][:, None], new, 0)
        log_z = np.logaddexp(fwd[-1][:, 0], fwd[-1][:, 1])
        p = np.exp(np.clip(fwd[..., 1] + bwd[..., 1] - log_z, -60, 0))
        grad = np.where(mask, y - p, 0)
        g_w = np.bincount(flat, np.repeat(grad[mask], ids.shape[2]), DIM) - 0.02 * weight
        g_b = grad.sum() - 0.02 * field.bias
        g_m = np.zeros((2, 2))
        for i in range(2):
            for j in range(2):
                pair = np.exp(np.clip(fwd[:-1, :, i] + m[i, j] + node[1:, :, j] + bwd[1:, :, j] - log_z, -60, 0))
                g_m[i, j] = (np.where(pair_mask, (y[:-1] == i) & (y[1:] == j), 0) - np.where(pair_mask, pair, 0)).sum() - 0.02 * m[i, j]
        sq_w += g_w**2
        sq_b += g_b**2
        sq_m += g_m**2
        weight += 0.5 * g_w / np.sqrt(sq_w)
        field.bias += 0.2 * g_b / np.sqrt(sq_b)
        field.move = m + 0.1 * g_m / np.sqrt(sq_m)
    field.weight = weight.astype(np.float32)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE, size: tuple[int, int] = BYTES) -> Field:
    """Fits on at most ``sample[label]`` ids and ``size[label]`` bytes of each label that aren't held out; reads docs once."""
    labelled = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & ~held_out())
    labelled = labelled.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").drop("most")
    picked = [labelled.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample[y]) for y in (0, 1)]
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") <= ROW_BYTES)
    found = found.join(F.broadcast(picked[0].union(picked[1])), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic"))
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("so_far", F.sum(F.octet_length("text")).over(order)).where(F.col("so_far") <= F.when(F.col("toxic") == 1, size[1]).otherwise(size[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        process_memory(None)
        held = list(batches)
        if held:
            field = fit((t.as_py() for b in held for t in b.column(1)), [y for b in held for y in b.column(2).to_pylist()])
            del held
            process_memory(None)  # gives back what fitting took, before the worker serves other tasks
            yield field.told()

    # In one task: the sample is bounded, and texts and fitting would be in the way of the driver, which plans all stages.
    row = found.select("doc_id", "text", "toxic").repartition(1).sortWithinPartitions("doc_id").mapInArrow(run, _FIELD).first()
    return Field.of(row) if row else fit([], [])


# --- scoring --------------------------------------------------------------------------------


def scored(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, score and spans ("start:end" in code points, comma-joined) for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        process_memory(None)
        known: dict[bytes, float] = {}

        def odds_of(words: list[bytes]) -> np.ndarray:
            try:
                return np.array([known[w] for w in words])
            except KeyError:
                if len(known) > MEMORY:
                    known.clear()
                for w in words:
                    if w not in known:
                        known[w] = field.emission(normal(w))
                return np.array([known[w] for w in words])

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for at in range(0, max(1, len(texts)), 1024):
                part = texts[at : at + 1024]
                if not part:
                    continue
                words = [(t or "").encode().split() for t in part]
                p = tagged(field, [odds_of(w) for w in words])
                total, most = np.array([v.sum() for v in p]), np.array([v.max() if len(v) else 0.0 for v in p])
                spans = [_spans(t or "", v) if m >= 0.5 else "" for t, v, m in zip(part, p, most, strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(part)), pa.array(field.score(total, most)), pa.array(spans, pa.string())], names=["doc_id", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, spans string")


def _spans(text: str, marginals: np.ndarray) -> str:
    """Runs of neighbouring tokens of 0.5 or more."""
    import re

    out: list[list[int]] = []
    last = -2
    for k, m in enumerate(re.finditer(r"[^\x20\x09-\x0D]+", text)):
        if marginals[k] >= 0.5:
            if last == k - 1:
                out[-1][1] = m.end()
            else:
                out.append([m.start(), m.end()])
            last = k
    return ",".join(f"{a}:{b}" for a, b in out)


def accepted(docs: DataFrame, labels: DataFrame, cut: float = 0.5) -> DataFrame:
    """The rows of docs whose score is under the cut, with all their columns. No shuffle."""
    field = train(docs, labels)

    def rejects(texts: pa.Array) -> pa.Array:
        process_memory(None)
        out, known = [], {}
        values = texts.to_pylist()
        for at in range(0, len(values), 1024):
            words = [(t or "").encode().split() for t in values[at : at + 1024]]
            if len(known) > MEMORY:
                known.clear()
            for w in {w for ws in words for w in ws}:
                if w not in known:
                    known[w] = field.emission(normal(w))
            p = tagged(field, [np.array([known[w] for w in ws]) for ws in words])
            out += (field.score(np.array([v.sum() for v in p]), np.array([v.max() if len(v) else 0.0 for v in p])) >= cut).tolist()
        return pa.array(out, pa.bool_())

    return docs.where(~F.arrow_udf(rejects, "boolean")(F.col("text").cast("string")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rows = scored(docs, train(docs, read(spark, sf_dir, "labels")))
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
