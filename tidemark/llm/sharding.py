"""Sharding by a permutation-filled lookup table.

Shards take turns claiming slots of a prime-sized table, each in the order of its own
permutation (offset + j * skip modulo the table size). A key's slot is its hash modulo the
table size, so placement is one lookup; adding or removing a shard moves few slots.

Defined cases: a null key hashes as the empty string, so all null keys share one shard; equal
keys land in the same shard; the table's size is a parameter and never grows with the data.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

SHARDS, SLOTS = 64, 65537


def _number(text: str) -> int:
    return int.from_bytes(hashlib.md5(text.encode()).digest()[:7], "big")


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


@lru_cache(maxsize=8)
def lookup_table(shards: tuple[str, ...], slots: int = SLOTS) -> np.ndarray:
    """slot -> index of the shard that claimed it."""
    if not is_prime(slots) or not 0 < len(set(shards)) == len(shards) <= slots:
        raise ValueError("slots must be prime and at least the number of distinct shards")
    orders = [((_number(f"offset:{s}") % slots + np.arange(slots, dtype=np.int64) * (_number(f"skip:{s}") % (slots - 1) + 1)) % slots).tolist() for s in shards]
    owner, at, left = [-1] * slots, [0] * len(shards), slots
    while left:
        for k, order in enumerate(orders):
            j = at[k]
            while owner[order[j]] >= 0:
                j += 1
            owner[order[j]], at[k] = k, j + 1
            left -= 1
            if not left:
                break
    return np.array(owner, dtype=np.int32)


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The first 52 bits of the key's MD5 modulo the table size; the same in any engine."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 13), 16, 10).cast("long"), F.lit(slots).cast("long")).cast("int")


def placed(df: DataFrame, key: str, shards: int | tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Adds slot and shard (an index into shards), in place of columns of these names. The broadcast side has exactly ``slots`` rows."""
    names = tuple(f"shard-{i}" for i in range(shards)) if isinstance(shards, int) else shards
    table = lookup_table(names, slots)
    spark = df.sparkSession
    rows = spark.createDataFrame([(i, int(k)) for i, k in enumerate(table)], "slot int, shard int")
    return df.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), slots)).join(F.broadcast(rows), "slot", "left")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(read(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("doc_id", "slot", "shard")


def op2_sql() -> str:
    """The lookup in SQL; the table's owners come as one text, two digits for each slot."""
    owners = "".join(f"{k:02d}" for k in lookup_table(tuple(f"shard-{i}" for i in range(SHARDS))).tolist())
    return f"""
WITH t AS (SELECT unnest(string_split(regexp_replace('{owners}', '(..)', '\\1 ', 'g'), ' ')) AS shard, unnest(range(0, {SLOTS} + 1)) AS slot),
d AS (SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT % {SLOTS} AS INTEGER) AS slot FROM documents)
SELECT doc_id, d.slot, CAST(shard AS INTEGER) AS shard FROM d JOIN t ON t.slot = d.slot
"""
