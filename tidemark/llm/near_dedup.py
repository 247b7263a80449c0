"""Near-duplicate documents: SuperMinHash signatures, banding, verification, grouping.

1. Each text becomes its set of word shingles, the set's digest, a signature and band hashes.
2. Equal sets (128-bit digests) form one class, named by the number of one of its rows, so copies
   cost nothing later.
3. Classes that share a band meet in buckets; buckets with the same members are one. In a
   bucket, block tasks compare signatures and emit the components of the pairs whose estimate
   comes near the limit, as stars. Components of all these edges are candidate clusters. The
   first bands go ahead, so that most buckets of the others turn out to be within one cluster.
4. In a cluster, block tasks compare the full sets of shingles exactly and emit the components
   of the true links in the same way; components of these edges are the result.

A group of more rows than a block first meets its centre, block by block, in linear time; then
only rows of different components are compared, all that are left. No step emits all pairs of a
group or holds more than two blocks of one, and none caps, samples or drops members. Joins on
buckets, clusters and classes take heavy keys apart (grouping.joined).

Slots per band and the estimate's bound follow from the limit (plan()). At 0.8 these are 32 bands
of 5 and 100 of 160 slots: a pair at the limit itself is missed by all bands with probability
3e-6 and by the estimate with 1e-7 at most, that of independent slots, to which long texts come
close; far less above it. Limits too low for any bands (under 7) are refused.

Defined cases: A-Z count as lower case; a text with fewer words than a shingle is one shingle;
a null text, or one without words, has an empty set, links with nothing and is kept; rows without
an id link like all others; a group whose rows all have none has no component_id. groups() answers
every row by itself, also repeated ones. deduplicated() keeps one row of each group: of the least
id, and of several rows with that id the one of the least text hash, so repeated rows go; other
columns don't matter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, read, splitmix, stored
from .grouping import BLOCK, MOST, across, components, heaviest, in_blocks, joined, linked, main_labels, marked
from .shingles import chunks, shingles
from .superminhash import bands, signatures

#: Signature slots, and the part of the pairs at the limit that bands and estimate may miss.
SLOTS, MISSED_BY_BANDS, MISSED_BY_ESTIMATE = 160, 1e-5, 1e-7
WORDS, LIMIT = 5, 80
_SKETCH = T.StructType().add("n_shingles", "long").add("d1", "long").add("d2", "long").add("signature", "binary").add("bands", T.ArrayType(T.LongType()))


def plan(limit: int) -> tuple[int, int]:
    """Slots per band, and the equal slots that a pair needs to be verified, for a limit in per cent."""
    s = limit / 100
    rows = [r for r in range(1, SLOTS + 1) if (1 - s**r) ** (SLOTS // r) <= MISSED_BY_BANDS] if 0 < s <= 1 else []
    if not rows:
        raise ValueError(f"no bands of {SLOTS} slots find pairs at a limit of {limit}")
    under, least = 0.0, 0
    while least < SLOTS and (under := under + math.comb(SLOTS, least) * s**least * (1 - s) ** (SLOTS - least)) <= MISSED_BY_ESTIMATE:
        least += 1
    return rows[-1] if s < 1 else SLOTS, least


def _digests(hashes: np.ndarray, bounds: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each sorted set."""
    size = np.diff(bounds)
    out = np.zeros(len(size), dtype=np.uint64)
    full = size > 0
    if full.any():
        place = np.arange(len(hashes), dtype=np.uint64) - np.repeat(bounds[:-1], size).astype(np.uint64) + np.uint64(seed << 40)
        out[full] = np.add.reduceat(splitmix(hashes ^ splitmix(place)), bounds[:-1][full])
    return splitmix(out ^ size.astype(np.uint64)).view(np.int64)


def sketches(docs: DataFrame, words: int, rows: int) -> DataFrame:
    """The rows of docs (doc_id, text, rest) with n_shingles, the set's digest d1 and d2, signature
    and bands; the last two null for empty sets."""

    def work(batch: pa.RecordBatch) -> pa.Table:
        parts = []
        for at, end, data, offsets in chunks(batch.column("text")):
            hashes, bounds = shingles(data, offsets, words)
            sig = signatures(hashes, bounds, SLOTS)
            keys, size = bands(sig, rows), np.diff(bounds)
            empty = pa.array(size == 0)
            small = np.ascontiguousarray(splitmix(sig) & np.uint64(0xFFFF)).astype(np.uint16)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1]), pa.int32()), pa.array(keys.ravel().view(np.int64)))
            none = pa.scalar(None)
            parts.append(
                pa.table(
                    {
                        **{c: batch.column(c).slice(at, end - at) for c in ("doc_id", "text", "rest")},
                        "n_shingles": pa.array(size.astype(np.int64)),
                        "d1": pa.array(_digests(hashes, bounds, 0)),
                        "d2": pa.array(_digests(hashes, bounds, 1)),
                        "signature": pc.if_else(empty, none.cast(pa.binary()), pa.array([r.tobytes() for r in small], pa.binary())),
                        "bands": pc.if_else(empty, none.cast(lists.type), lists),
                    }
                )
            )
        return pa.concat_tables(parts) if parts else None

    return map_arrow(docs, T.StructType([*docs.schema.fields, *_SKETCH.fields]), work)


def _estimates(least: int):
    def alike(one: pa.Table, two: pa.Table) -> np.ndarray:
        a, b = (np.frombuffer(b"".join(t["signature"].to_pylist()), dtype=np.uint16).reshape(t.num_rows, -1) for t in (one, two))
        out = np.empty((len(a), len(b)), dtype=bool)
        for i in range(0, len(a), 32):
            out[i : i + 32] = (a[i : i + 32, None, :] == b[None, :, :]).sum(axis=2) >= least
        return out

    return alike


def _exact(limit: int):
    def alike(one: pa.Table, two: pa.Table) -> np.ndarray:
        same = one is two
        tables = (one,) if same else (one, two)
        sets = [np.frombuffer(x, dtype=np.uint64) for t in tables for x in t["shingles"].to_pylist()]
        size = np.array([len(s) for s in sets], dtype=np.int64)
        values, code = np.unique(np.concatenate(sets), return_inverse=True)
        row, n = np.repeat(np.arange(len(sets)), size), one.num_rows
        shared = np.bincount(code, minlength=len(values)) > 1
        column = np.cumsum(shared) - 1
        keep = shared[code]
        code, row, wide = column[code[keep]], row[keep], int(shared.sum())
        order = np.argsort(code, kind="stable")
        code, row = code[order], row[order]
        both = np.zeros((n, n if same else len(sets) - n), dtype=np.int64)
        for c in range(0, wide, 8192):
            lo, hi = np.searchsorted(code, (c, c + 8192))
            m = np.zeros((len(sets), min(8192, wide - c)), dtype=np.float32)
            m[row[lo:hi], code[lo:hi] - c] = 1
            both += np.rint(m[:n] @ (m if same else m[n:]).T).astype(np.int64)
        union = size[:n, None] + (size if same else size[n:])[None, :] - both
        return 100 * both >= limit * union

    return alike


def _sets(rows: DataFrame, words: int) -> DataFrame:
    """The rows with the set of their text's shingles instead of the text."""

    def work(batch: pa.RecordBatch) -> pa.Table:
        parts = []
        for at, end, data, offsets in chunks(batch.column("text")):
            hashes, bounds = shingles(data, offsets, words)
            t = pa.Table.from_batches([batch.slice(at, end - at)]).drop_columns(["text"])
            parts.append(t.append_column("shingles", pa.array([hashes[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary())))
        return pa.concat_tables(parts) if parts else None

    return map_arrow(rows, T.StructType([f for f in rows.schema.fields if f.name != "text"]).add("shingles", "binary"), work)


def _labelled(classes: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Adds the label of each class's component; a class without links is its own."""
    if labels is None:
        return classes.withColumn("label", F.col("node"))
    return classes.join(labels.withColumnRenamed("label", "__l"), "node", "left").withColumn("label", F.coalesce("__l", "node")).drop("__l")


def _met(classes: DataFrame, bands_: Column, least: int) -> tuple[DataFrame, DataFrame | None]:
    """Edges (a, b) between labels whose members share a band and have ``least`` equal slots, and
    the buckets larger than a block, not all of whose members were compared.

    Buckets of one label have nothing to add; of those with the same members one is enough.
    """
    entries = classes.select(F.explode(bands_).alias("bucket"), "node", "label")
    held = entries.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(3), "node")).alias("y"),
        F.min("label").alias("low"), F.max("label").alias("high"), F.min("node").alias("first"),
    )
    held = stored(held.where("low < high").groupBy("n", "x", "y", "first").agg(F.min("bucket").alias("bucket")), "buckets")
    told = heaviest(held)
    members = joined(entries, held.select("bucket", F.col("n").alias("size"), "first"), ["bucket"], held, told=told)
    signed = members.withColumn("centre", F.col("node") == F.col("first")).drop("first").join(classes.select("node", "signature"), "node")
    edges = stored(linked(in_blocks(signed, "bucket", "node", "size", "centre"), "bucket", _estimates(least)), "near")
    return edges, held.where(F.col("n") > BLOCK).select("bucket") if told[1] > BLOCK else None


def _candidates(classes: DataFrame, per_band: int, least: int) -> DataFrame:
    """(node, label) of candidate clusters."""
    many = SLOTS // per_band
    first = -(-many // 4)  # bands that form the first clusters
    early, large = _met(_labelled(classes, None), F.slice("bands", 1, first), least)
    late, more = _met(_labelled(classes, components(early)), F.slice("bands", first + 1, many - first), least)
    found = early.union(late)
    if larges := [x for x in (large, more) if x is not None]:  # members of large buckets that their centres didn't join
        large = larges[0].union(larges[-1]).distinct()
        n = large.count()
        entries = _labelled(classes, components(found)).select(F.explode("bands").alias("bucket"), "node", "label")
        inside = stored(entries.join(F.broadcast(large) if n <= MOST else large, "bucket"), "inside")
        mixed = stored(main_labels(inside, "bucket"), "mixed")
        if not mixed.isEmpty():
            members = joined(inside, mixed, ["bucket"], mixed.withColumn("n", F.col("size"))).join(classes.select("node", "signature"), "node")
            found = found.union(stored(linked(across(members, "bucket", "node"), "bucket", _estimates(least)), "near"))
    return components(found)


def _verified(clusters: DataFrame, texts: DataFrame, words: int, limit: int) -> DataFrame:
    """(node, label) of true links: within each candidate cluster full sets are compared."""
    clusters = clusters.select("node", F.col("label").alias("cluster"))
    sizes = stored(clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")), "sizes")
    told = heaviest(sizes)
    # The texts of clustered classes, once: they serve both rounds. Those of no cluster don't travel.
    inside = marked(texts, clusters, "node")
    rows = stored(joined(clusters, sizes.withColumnRenamed("n", "size"), ["cluster"], sizes, told=told).join(inside, "node"), "clustered")
    sets = _sets(rows, words).withColumn("label", F.col("node")).withColumn("centre", F.col("node") == F.col("cluster"))
    true = stored(linked(in_blocks(sets, "cluster", "node", "size", "centre"), "cluster", _exact(limit)), "true")
    if told[1] <= BLOCK:
        return components(true)
    known = stored(_labelled(rows.where(F.col("size") > BLOCK).drop("size"), components(true)), "known")
    mixed = stored(main_labels(known, "cluster"), "mixed")
    if mixed.isEmpty():
        return components(true)
    left = _sets(joined(known, mixed, ["cluster"], mixed.withColumn("n", F.col("size"))), words)
    return components(true.union(stored(linked(across(left, "cluster", "node"), "cluster", _exact(limit)), "true")))


def _answered(docs: DataFrame, words: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """The rows of docs as stored (rid, doc_id, text, rest, ...), and for each of them rid, doc_id,
    n_shingles, h (the text's hash), group (null for an empty set) and component_id."""
    per_band, least = plan(limit)
    more = [c for c in docs.columns if c not in ("doc_id", "text")]
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.struct(*more) if more else F.lit(None).cast("int")).alias("rest"))
    rows = stored(sketches(plain, words, per_band).withColumn("rid", F.monotonically_increasing_id()), "sketches")
    copies = rows.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min("rid").alias("node"), F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    copies = stored(copies, "copies")
    classes = stored(rows.select(F.col("rid").alias("node"), "signature", "bands").join(copies.select("node"), "node"), "classes")
    true = _verified(_candidates(classes, per_band, least), rows.select(F.col("rid").alias("node"), "text"), words, limit)
    # A component's id is the least doc_id of its classes.
    ids = _labelled(copies.select("d1", "d2", "node", "first_id"), true)
    least_id = stored(ids.groupBy("label").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "ids")
    named = joined(ids, least_id.select("label", "component_id"), ["label"], least_id).select("d1", "d2", F.col("label").alias("group"), "component_id")
    light = rows.select("rid", "doc_id", "n_shingles", F.xxhash64("text").alias("h"), "d1", "d2")  # no text goes through the join
    full = joined(light.where("n_shingles > 0"), named, ["d1", "d2"], copies)
    return rows, full.unionByName(light.where("n_shingles = 0").withColumn("group", F.lit(None).cast("long")).withColumn("component_id", F.col("doc_id")))


def groups(docs: DataFrame, words: int = WORDS, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text)."""
    out = _answered(docs.select("doc_id", "text"), words, limit)[1].select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, words: int = WORDS, limit: int = LIMIT) -> DataFrame:
    """One row of each group of docs, with all columns, and all rows with empty sets."""
    rows, told = _answered(docs, words, limit)
    least = told.where(F.col("group").isNotNull() & F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("group").agg(F.min(F.struct("h", "rid")).alias("least"))
    picked = least.select("least.rid").union(told.where(F.col("group").isNull()).select("rid"))
    own = {"doc_id": F.col("doc_id"), "text": F.col("text")}
    return marked(rows, picked, "rid").select(*[own[c].alias(c) if c in own else F.col("rest")[c].alias(c) for c in docs.columns])


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(read(spark, sf_dir, "documents"), words=2)


OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda v: v <> '') AS ws FROM documents),
g AS (SELECT doc_id, CASE WHEN len(ws) = 1 THEN [ws[1]] ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS gs FROM d),
n AS (SELECT doc_id, CAST(len(gs) AS BIGINT) AS n FROM g),
s AS (SELECT doc_id, unnest(gs) AS gram FROM g),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT n.doc_id, n.n AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept FROM n JOIN c ON c.doc_id = n.doc_id
"""
