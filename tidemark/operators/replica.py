"""Replicated reads and repairs over versions (node, key columns, ts, ...)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lww import latest


def quorum_read(versions: DataFrame, keys: Sequence[str], answered: DataFrame, need: int, order: Sequence[str]) -> DataFrame:
    """The newest version of each key among the first ``need`` nodes that answered (node, rank)."""
    chosen = answered.where(F.col("rank") <= need).select("node")
    return latest(versions.join(F.broadcast(chosen), "node", "left_semi"), keys, order)


def stale(versions: DataFrame, keys: Sequence[str], replicas: DataFrame, ts: str) -> DataFrame:
    """(keys, node, held_ts, newest_ts) for each replica that lacks a key's newest version.

    replicas has one row per key and replica node, so nothing is multiplied beyond what the
    repair may have to write.
    """
    newest = versions.groupBy(*keys).agg(F.max(ts).alias("newest_ts"))
    held = versions.groupBy(*keys, "node").agg(F.max(ts).alias("held_ts"))
    return replicas.join(newest, list(keys)).join(held, [*keys, "node"], "left").where(F.col("held_ts").isNull() | (F.col("held_ts") < F.col("newest_ts")))


def replayed(hints: DataFrame, recovered: DataFrame) -> DataFrame:
    """The hinted mutations of nodes that are back."""
    return hints.join(F.broadcast(recovered), "node", "left_semi")


def after_replay(log: DataFrame, hints: DataFrame, recovered: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Each node's newest rows once the hints of recovered nodes are applied."""
    return latest(log.unionByName(replayed(hints, recovered)), ["node", *keys], order)


def write_outcome(owners: DataFrame, nodes: DataFrame, keys: Sequence[str], need: int) -> tuple[DataFrame, DataFrame]:
    """(keys, n_acks, ok) of each write, and the hints (keys, node) for replicas that didn't take it.

    owners: a row for each key and replica node; nodes: node, up. A write is ok with ``need``
    acknowledgements; hints are kept for the others either way, so that they can catch up.
    """
    sent = owners.join(F.broadcast(nodes), "node", "left").withColumn("up", F.coalesce("up", F.lit(False)))
    acks = sent.groupBy(*keys).agg(F.count_if("up").alias("n_acks")).withColumn("ok", F.col("n_acks") >= need)
    return acks, sent.where("NOT up").select(*keys, "node")


def replay_until_failure(hints: DataFrame, order: str, fails: Column) -> DataFrame:
    """Hints with ``delivered``: per node in order, up to the first one that fails; that one and all
    after it go back to the queue."""
    first = hints.where(fails).groupBy("node").agg(F.min(order).alias("__stop"))  # a row for each node
    return hints.join(F.broadcast(first), "node", "left").withColumn("delivered", F.col("__stop").isNull() | (F.col(order) < F.col("__stop"))).drop("__stop")


def merged_counts(answers: DataFrame, statement: str, count: str) -> DataFrame:
    """How many rows a statement changed: replicas repeat one change, so the greatest answer counts."""
    return answers.groupBy(statement).agg(F.max(count).alias(count))


def merged_names(answers: DataFrame, name: str) -> DataFrame:
    """The names that any replica knows, in order."""
    return answers.select(name).distinct().orderBy(name)


def ballots(df: DataFrame, slot: Sequence[str], ts: str, salt: str) -> DataFrame:
    """The winning proposal of each slot: the greatest (ts, salt) pair, never a packed number."""
    return latest(df, slot, [ts, salt])
