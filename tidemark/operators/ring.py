"""Token ring, replica choice and consistency levels."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.murmur import murmur3, murmur3_32


def ring(nodes: list[str], vnodes: int = 8) -> list[tuple[int, str]]:
    """(token, node) in token order; of two nodes with one token the later one holds it."""
    names = [f"{n}-{v}" for n in nodes for v in range(max(vnodes, 1))]
    owners = [n for n in nodes for _ in range(max(vnodes, 1))]
    held = dict(zip(murmur3([x.encode() for x in names]).tolist(), owners, strict=True))
    return sorted(held.items())


def ring_table(spark: SparkSession, nodes: list[str], vnodes: int = 8) -> DataFrame:
    return spark.createDataFrame(ring(nodes, vnodes), "token long, node string")


def walk(tokens: list[tuple[int, str]], at: int, copies: int) -> list[str]:
    """The first distinct nodes clockwise from position ``at``."""
    out: list[str] = []
    for i in range(len(tokens)):
        node = tokens[(at + i) % len(tokens)][1]
        if node not in out:
            out.append(node)
        if len(out) == copies:
            break
    return out


def replicas(df: DataFrame, key: Column, nodes: list[str], copies: int, vnodes: int = 8) -> DataFrame:
    """Adds token and replicas (array of nodes, nearest first).

    The ring has nodes * vnodes entries whatever the data; its arcs, each with its replicas, are
    a literal that a binary search over the sorted tokens indexes.
    """
    held = ring(nodes, vnodes)
    tokens = F.array(*[F.lit(t).cast("long") for t, _ in held])
    choices = F.array(*[F.array(*map(F.lit, walk(held, i, copies))) for i in range(len(held))])
    out = df.withColumn("token", murmur3_32(key))
    low, high = F.lit(0), F.lit(len(held))
    arc = F.aggregate(
        F.sequence(F.lit(1), F.lit(len(held).bit_length())),
        F.struct(low.alias("lo"), high.alias("hi")),
        lambda s, _: F.when(s["lo"] >= s["hi"], s)
        .when(F.get(tokens, F.floor((s["lo"] + s["hi"]) / 2).cast("int")) < F.col("token"), F.struct((F.floor((s["lo"] + s["hi"]) / 2).cast("int") + 1).alias("lo"), s["hi"].alias("hi")))
        .otherwise(F.struct(s["lo"].alias("lo"), F.floor((s["lo"] + s["hi"]) / 2).cast("int").alias("hi"))),
    )["lo"]
    return out.withColumn("__arc", arc % len(held)).withColumn("replicas", F.get(choices, F.col("__arc"))).drop("__arc")


def replicas_of(key: str, nodes: list[str], copies: int, vnodes: int = 8) -> list[str]:
    """One key's replicas, without Spark."""
    held = ring(nodes, vnodes)
    at = bisect_left([t for t, _ in held], int(murmur3([key.encode()])[0])) % len(held)
    return walk(held, at, copies)


def required(level: Column, copies: Column) -> Column:
    """Acknowledgements that a consistency level asks for. A level may be a number: up to 1 it is
    ONE, from the number of copies on ALL, between them QUORUM."""
    n = level.try_cast("int")
    level = F.when(n <= 1, "ONE").when(n >= copies, "ALL").when(n.isNotNull(), "QUORUM").otherwise(level)
    return F.when(level == "ONE", F.lit(1)).when(level == "QUORUM", F.floor(copies / 2).cast("int") + 1).when(level == "ALL", F.greatest(copies, F.lit(1)))


def healthy(now: Column, panic_until: Column, free_bytes: Column, total_bytes: Column, least: float = 0.05) -> Column:
    """Whether a node calls itself healthy: past its panic time (null: none), and disk enough left."""
    return (F.coalesce(panic_until, now) <= now) & (free_bytes >= least * total_bytes)


def targets(statements: DataFrame, placed: DataFrame, nodes: DataFrame, statement: str, keys: Sequence[str]) -> DataFrame:
    """(statement, node): the nodes that a statement goes to.

    statements: statement, ``kind`` ('keys', 'broadcast' or 'self'), ``home`` and the key columns,
    one row for each key; placed: key columns and node, a row for each replica; nodes: node.
    """
    of_keys = statements.where("kind = 'keys'").join(placed, list(keys)).select(statement, "node")
    everywhere = statements.where("kind = 'broadcast'").select(statement).distinct().join(F.broadcast(nodes.select("node")))  # nodes: a ring's
    return of_keys.union(everywhere).union(statements.where("kind = 'self'").select(statement, F.col("home").alias("node"))).distinct()


def alive(last_seen: Column, now: Column, limit_s: int = 8) -> Column:
    return now - last_seen < F.lit(limit_s)
