"""Merge on read: the last write of each key wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], deleted: str | None = None) -> DataFrame:
    """The row of each key that is last by ``order`` (a total order within a key).

    Planned as WindowGroupLimit, before and after one exchange on the keys, so versions that
    can't win are dropped before the shuffle. Filters on keys reach the scan; filters on other
    columns stay above, as they must. Tombstones win like any write and then disappear.
    """
    by = [(F.col(o) if isinstance(o, str) else o).desc_nulls_last() for o in order]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
    out = df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")
    return out.where(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted) if deleted else out


def latest_values(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The same by max_by: better where keys have many versions, as map tasks pre-aggregate."""
    version = F.struct(*order)
    return df.groupBy(*keys).agg(*[F.max_by(v, version).alias(v) for v in values])


def overlay(older: DataFrame, newer: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of two layers; where both have a key the newer layer's row is taken."""
    both = older.withColumn("__layer", F.lit(0)).unionByName(newer.withColumn("__layer", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, ["__layer"]).drop("__layer")
