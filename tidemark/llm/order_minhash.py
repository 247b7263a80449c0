"""Order MinHash fingerprints in SQL functions alone.

A text's words form k-mers; each is numbered by its occurrence, so that repeats count. Every
component ranks all numbered k-mers by a permutation of its own, takes the L minimal ones, puts
them back in text order and hashes the tuple. Equal components therefore speak for common content
in a common order, which follows edit distance rather than set overlap. A tuple holds L k-mers
whenever the text has so many, however short it is.

The BANDS permutations come from HASHES hashes: a component's ranks are one of them, XOR a constant
of the component that differs from the others' in the top bits. XOR with a constant permutes the
ranks, so each component on its own is a fair draw, and none needs a pass of its own: the minimal
k-mers of a component lie in the part of the sorted ranks that shares its top bits, or, where
that part holds fewer than L, in the next nearest ones. The L first of each part are thus enough
for all components. Components of one hash share k-mers in texts of few k-mers, which adds to the
variance there, not to the bias. Everything happens inside a row, in arrays, in time n log n.

Defined cases: a null text is empty; a text of fewer than K words is one k-mer; a text without
words has an empty fingerprint, and two of those are alike (1.0), one and any other are not (0.0);
k-mers of equal rank count by position; positions are kept modulo 2**24, so in a text of more
words only the order within its own tuples can suffer. Documents without an id come first, by the
hash of their text; equal ids are ordered by text. A single document is its own successor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read

#: Words per k-mer, components, k-mers per component, hashes that the components' ranks come from.
K, BANDS, L, HASHES = 2, 64, 2, 2
#: Bits of a packed entry: rank and position; and of a component's hash.
_RANK, _POS, _HASH = 39, 24, 26
#: Range buckets per shuffle partition in which neighbours are looked up.
SPREAD = 8
_SPACES = r"' \u0009\u000A\u000B\u000C\u000D'"


def let(value: str, name: str, body: str) -> str:
    """SQL that binds a value to a name once; a lambda would else make it for each element."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def sketch(text: str, k: int = K, bands: int = BANDS, size: int = L, hashes: int = HASHES) -> Column:
    """array<bigint>, one entry per component: component << 26 | hash; empty for a text without words.

    text is SQL for a string that isn't null.
    """
    parts = bands // hashes
    bits = parts.bit_length() - 1
    if parts * hashes != bands or 1 << bits != parts or k < 1 or size < 1:
        raise ValueError("bands must be a power of two for each hash, k and size at least 1")
    low, cut, top = (1 << _POS) - 1, 64 - _RANK, _RANK + _POS - bits
    grams = "".join(f", get(ws, i + {j})" for j in range(1, k))
    # es: the top 39 bits of each k-mer's hash over its position, sorted, so that equal k-mers are neighbours
    entries = f"""sort_array(transform(slice(ws, 1, greatest(size(ws) - {k - 1}, 1)),
        (w, i) -> shiftleft(shiftrightunsigned(xxhash64(w{grams}), {cut}), {_POS}) | (i & {low})))"""
    # rs: where runs of equal k-mers start; ns: the number of each entry within its run
    runs = f"filter(sequence(0, size(es) - 1), i -> i = 0 OR shiftright(get(es, i - 1), {_POS}) <> shiftright(get(es, i), {_POS}))"
    numbers = "CASE WHEN size(rs) < size(es) THEN flatten(transform(rs, (s, j) -> sequence(0, coalesce(get(rs, j + 1), size(es)) - s - 1))) END"
    found = []
    for h in range(hashes):
        # os: rank and position, sorted; fs: the first L entries of each part
        order = f"sort_array(transform(es, (e, i) -> shiftleft(shiftrightunsigned(xxhash64(shiftright(e, {_POS}), coalesce(get(ns, i), 0), {h}), {cut}), {_POS}) | (e & {low})))"
        firsts = f"filter(os, (o, i) -> i < {size} OR shiftright(get(os, i - {size}), {top}) <> shiftright(o, {top}))"
        # a component's minimal entries: its own part if that is full, else those nearest by XOR
        nearest = f"transform(slice(sort_array(transform(fs, f -> f ^ shiftleft(b, {top}))), 1, {size}), f -> f ^ shiftleft(b, {top}))"
        own = f"CASE WHEN size(fs) = {size * parts} THEN slice(fs, CAST(b AS INT) * {size} + 1, {size}) ELSE {nearest} END"
        # the tuple: ranks in text order
        tuple_ = f"transform(sort_array(transform({own}, c -> shiftleft(c & {low}, {_RANK}) | shiftright(c, {_POS}))), c -> c & {(1 << _RANK) - 1})"
        body = f"transform(sequence(0L, {parts - 1}L), b -> shiftleft(b + {h * parts}, {_HASH}) | shiftrightunsigned(xxhash64({tuple_}), {64 - _HASH}))"
        found.append(let(order, "os", let(firsts, "fs", body)))
    bound = let(entries, "es", let(runs, "rs", let(numbers, "ns", f"concat({', '.join(found)})")))
    words = rf"split(btrim({text}, {_SPACES}), r'[\x20\x09-\x0D]+')"
    return F.expr(f"CASE WHEN btrim({text}, {_SPACES}) = '' THEN CAST(array() AS array<bigint>) ELSE {let(words, 'ws', bound)} END")


def hexed(sketch_: str) -> Column:
    """A fingerprint as text: eight hex digits for each component."""
    return F.expr(f"array_join(transform({sketch_}, x -> lpad(lower(hex(x)), 8, '0')), '')")


def likeness(a: str, b: str) -> Column:
    """Share of equal components; of two empty fingerprints 1.0, of one and another 0.0."""
    return F.expr(f"CASE WHEN size({a}) = 0 AND size({b}) = 0 THEN 1D ELSE size(array_intersect({a}, {b})) / CAST(greatest(size({a}), size({b})) AS DOUBLE) END")


def with_next(docs: DataFrame, key: str, carry: list[str], buckets: int) -> DataFrame:
    """Adds next_<c> of the row that follows by (key, carry[0]), the first row's after the last.

    Rows go to range buckets of the key, and the rows at a bucket's lower bound also visit the
    bucket before, so each bucket sees its successor without one global sort. Rows without a key
    come first, in buckets by the hash of carry[0]. The bounds are the least keys and hashes of the
    buckets; their number is a parameter, as in any range partitioning.
    """
    none = F.col(key).isNull()
    rows = docs.withColumn("__k", F.when(none, F.xxhash64(carry[0])).otherwise(F.col(key)))

    def upto(bounds: list[int]) -> Column:
        """The number of bounds that are at most the key, by binary search."""
        held = F.array(*[F.lit(int(b)).cast("long") for b in bounds]).cast("array<bigint>")
        middle = lambda s: ((s["lo"] + s["hi"]) / 2).cast("int")
        step = lambda s, _: F.when(s["lo"] >= s["hi"], s).when(F.get(held, middle(s)) <= F.col("__k"), F.struct((middle(s) + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), middle(s).alias("hi")))
        return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, len(bounds).bit_length()))), F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")), step)["lo"]

    def bounds_of(part: DataFrame) -> list[int]:
        """The least key of each bucket. Percentiles are doubles, so they only tell roughly where to cut."""
        cuts = part.agg(F.percentile_approx("__k", [i / buckets for i in range(1, buckets)] or [0.5], 10 * buckets)).first()[0]
        return sorted(r["least"] for r in part.groupBy(upto(sorted({*cuts})).alias("b")).agg(F.min("__k").alias("least")).collect()) if cuts else []

    bounds = [bounds_of(rows.where(none)) if not docs.where(none).isEmpty() else [], bounds_of(rows.where(~none))]
    last = max(len(bounds[0]) + len(bounds[1]) - 1, 0)
    held = [F.array(*[F.lit(int(b)).cast("long") for b in bounds[i]]).cast("array<bigint>") for i in (0, 1)]
    rows = rows.withColumn("__b", F.when(none, upto(bounds[0]) - 1).otherwise(upto(bounds[1]) + len(bounds[0]) - 1))
    rows = rows.withColumn("__at", F.when(none, F.get(held[0], F.col("__b"))).otherwise(F.get(held[1], F.col("__b") - len(bounds[0]))) == F.col("__k"))
    visit = F.when(F.col("__at"), F.when(F.col("__b") > 0, F.col("__b") - 1).otherwise(F.lit(last)))
    places = F.concat(F.array(F.struct(F.col("__b").alias("b"), F.lit(0).alias("g"))), F.transform(F.array_compact(F.array(visit)), lambda b: F.struct(b.alias("b"), F.lit(1).alias("g"))))
    rows = rows.withColumn("__p", F.explode(places)).select(*docs.columns, "__k", F.col("__p.b").alias("__b"), F.col("__p.g").alias("__g"))
    order = Window.partitionBy("__b").orderBy("__g", F.col(key).isNotNull(), "__k", F.col(carry[0]).asc_nulls_first())
    return rows.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carry]).where("__g = 0").drop("__b", "__g", "__k")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprints of each text and its edited text, and their likeness."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_next(rows.withColumn("sketch", sketch("text")), "doc_id", ["text", "sketch"], max(1, n * SPREAD))
    cut = "CAST(floor(length(text) / 4) AS INT)"
    rows = rows.withColumn("edited", F.expr(f"concat(substring(text, 1, length(text) - {cut}), substring(next_text, 1, {cut}))"))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "sketch", sketch("edited").alias("edited_sketch"), "next_sketch")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", hexed("sketch").alias("fingerprint"), hexed("edited_sketch").alias("edited_fingerprint"),
        likeness("sketch", "edited_sketch").alias("near_edited"), likeness("sketch", "next_sketch").alias("near_next"),
    )


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents"))
