"""Data skipping structures as DataFrames: zone maps, Bloom filters, sparse indexes.

Parquet keeps all three in its files (row-group statistics, Bloom filters, page indexes) and
Spark's scans use them. These are the same structures in the open, for tables of segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 1024
STEP = 16


def zone_map(df: DataFrame, segment: str, key: str) -> DataFrame:
    return df.groupBy(segment).agg(F.min(key).alias("min_key"), F.max(key).alias("max_key"), F.count(F.lit(1)).alias("n_keys"))


def in_zone(key: Column) -> Column:
    """An unbounded side lets every key pass."""
    return (F.col("min_key").isNull() | (F.col("min_key") <= key)) & (F.col("max_key").isNull() | (F.col("max_key") >= key))


def bit_places(key: Column, bits: int = BITS) -> Column:
    """The two bits of a text key. Both hashes are polynomials over its UTF-8 bytes; as bits divides
    2**64, reducing at each step equals wrapping at 64 bits and reducing at the end."""
    plain = F.transform(F.filter(F.split(key, ""), lambda c: c != ""), lambda c: F.ascii(c))
    digits, size = F.hex(F.encode(key, "UTF-8")), F.octet_length(key)
    each = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.conv(F.substring(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("int"))
    codes = F.when(size == F.length(key), plain).otherwise(each)  # where all signs are ASCII, signs are bytes
    h1 = F.aggregate(codes, F.lit(5381 % bits).cast("long"), lambda h, c: (h * 33 + c) % bits)
    h2 = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c) % bits)
    return F.array(h1, h2)


def bloom(df: DataFrame, segment: str, key: Column, bits: int = BITS) -> DataFrame:
    """One row per segment: the set bits in order. At most ``bits`` values per group."""
    return df.select(segment, F.explode(bit_places(key, bits)).alias("bit")).groupBy(segment).agg(F.sort_array(F.collect_set("bit")).alias("bits"))


def may_contain(key: Column, bits: int = BITS) -> Column:
    """Against a column ``bits``; never false for a key that was added."""
    places = bit_places(key, bits)
    return F.array_contains("bits", places[0]) & F.array_contains("bits", places[1])


def segments_with(probes: DataFrame, blooms: DataFrame, segment: str, key: str) -> DataFrame:
    """(key, n_segments) for each probe: in how many segments' filters both its bits are set.

    For each bit one bitmap of the segments, in words of 64; the two bitmaps of a probe are ANDed
    word by word. Probes with equal bits are one, so at most bits * bits of them meet the words.
    """
    of = F.col(segment).cast("long")
    words = blooms.select(F.explode("bits").alias("bit"), F.floor(of / 64).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(of, F.lit(64)).cast("int")).alias("m"))
    words = words.groupBy("bit", "w").agg(F.bit_or("m").alias("m"))
    asked = probes.select(key, bit_places(F.col(key)).alias("p")).select(key, F.col("p")[0].alias("a"), F.col("p")[1].alias("b"))
    pairs = asked.select("a", "b").distinct()
    one = pairs.join(words.select(F.col("bit").alias("a"), "w", F.col("m").alias("x")), "a")
    both = one.join(words.select(F.col("bit").alias("b"), "w", F.col("m").alias("y")), ["b", "w"])
    counts = both.groupBy("a", "b").agg(F.sum(F.bit_count(F.col("x").bitwiseAND(F.col("y")))).cast("long").alias("n_segments")).where("n_segments > 0")
    return asked.join(counts, ["a", "b"]).select(key, "n_segments")


def sparse_index(df: DataFrame, segment: str, key: str, length: Column, step: int = STEP) -> DataFrame:
    """Every step-th key of a segment, in key order, with the byte offset at which it starts."""
    order = Window.partitionBy(segment).orderBy(key)
    rows = df.select(segment, key, F.row_number().over(order).alias("nth"), (F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, 0)) - length).alias("offset"))
    return rows.where((F.col("nth") - 1) % step == 0).select(segment, F.col(key).alias("index_key"), F.col("offset").cast("long").alias("offset"))


def seek(probes: DataFrame, index: DataFrame, segment: str, key: str) -> DataFrame:
    """The offset from which to scan for each probe: that of the last index key not above it, or 0.

    Probes and index entries in one order of keys, and the last offset so far: offsets rise with
    the keys. No probe meets more than its own segment's rows, and none is multiplied.
    """
    entries = index.select(segment, F.col("index_key").alias(key), F.lit(0).alias("__kind"), F.col("offset").alias("__offset"))
    asked = probes.withColumn("__kind", F.lit(1)).withColumn("__offset", F.lit(None).cast("long"))
    upto = Window.partitionBy(segment).orderBy(key, "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = asked.unionByName(entries, allowMissingColumns=True).withColumn("offset", F.coalesce(F.max("__offset").over(upto), F.lit(0).cast("long")))
    return both.where("__kind = 1").select(*probes.columns, "offset")
