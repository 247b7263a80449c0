"""Inserts, updates, deletes and conditional writes as DataFrames of mutations."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def absent(incoming: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The incoming rows whose key has no row yet."""
    return incoming.join(current.select(*keys), list(keys), "left_anti")


def merged(changes: DataFrame, current: DataFrame, keys: Sequence[str], assign: Mapping[str, Column], columns: Sequence[str]) -> DataFrame:
    """Full rows after an upsert: assigned columns from the change, the others from the old row."""
    old = current.select(*keys, *[F.col(c).alias(f"__old_{c}") for c in columns if c not in keys])
    joined = changes.join(old, list(keys), "left")
    return joined.select(*[F.col(c) if c in keys else assign[c].alias(c) if c in assign else F.col(f"__old_{c}").alias(c) for c in columns])


def matches(current: DataFrame, expect: Mapping[str, Any]) -> Column:
    """Whether a row has the expected values; null equals null."""
    out = F.lit(True)
    for c, v in expect.items():
        out = out & F.col(c).eqNullSafe(F.lit(v).cast(current.schema[c].dataType))
    return out


def compared(changes: DataFrame, current: DataFrame, keys: Sequence[str], column: str, expected: str, value: str) -> DataFrame:
    """Conditional updates of many keys at once: ``applied`` and the value after each.

    A key without a row never matches, not even an expected null.
    """
    old = current.select(*keys, F.col(column).alias("__old"), F.lit(True).alias("__there"))
    joined = changes.join(old, list(keys), "left")
    applied = F.coalesce(F.col("__there"), F.lit(False)) & F.col("__old").eqNullSafe(F.col(expected))
    return joined.withColumn("applied", applied).withColumn("after", F.when(F.col("applied"), F.col(value)).otherwise(F.col("__old"))).drop("__old", "__there")


def fold_conditional(writes: DataFrame, keys: Sequence[str], order: str, expected: str, value: str) -> DataFrame:
    """Runs each key's conditional writes one after the other, in ``order``.

    A write applies if the value before it equals its expected value (null: no value yet).
    Returns the keys, how many writes applied and the final value. A key's writes come sorted (by
    order, then expected and new value) and are folded one by one as they stream past, so a key
    with very many writes takes time, as it must, but no memory.
    """
    keys, schema = list(keys), writes.schema
    out = T.StructType([*[schema[k] for k in keys], T.StructField("n_applied", T.LongType()), T.StructField("final", schema[value].dataType)])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, n, done = None, None, 0, []
        for batch in batches:
            for *now, e, v in zip(*(batch.column(c).to_pylist() for c in (*keys, expected, value)), strict=True):
                if now != key:
                    if key is not None:
                        done.append((*key, n, held))
                    key, held, n = now, None, 0
                if held == e:
                    held, n = v, n + 1
            if len(done) >= 10_000:
                yield _batch(done)
                done = []
        if key is not None:
            done.append((*key, n, held))
        if done:
            yield _batch(done)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=out.names)

    kinds = [to_arrow_type(f.dataType) for f in out.fields]
    dealt = writes.select(*keys, order, expected, value).repartition(*keys).sortWithinPartitions(*keys, order, expected, value)
    return dealt.mapInArrow(fold, out)


def delete_where(current: DataFrame, condition: Column, ts: str, at: Column, deleted: str) -> DataFrame:
    """Tombstones, newer than what they delete, for all current rows that a condition holds for: a
    key prefix, or a whole table."""
    return current.where(condition).withColumn(ts, at).withColumn(deleted, F.lit(True))
