"""Groups of rows in Arrow streams, block tasks for groups of any size, joins on keys that may be
heavy, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import erase, process_memory, put, stored

#: Rows of a group that one task compares with as many others.
BLOCK = 256
#: A key of so many rows is heavy; at most so many keys are.
HEAVY, MOST = 256, 20_000
#: Words of 64 marks that are broadcast at most, 64 MB or so in memory.
MARKS = 1 << 20


def by_group(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables of rows with equal integer keys, from batches that are sorted by these."""
    process_memory(None)
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(k)) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def heaviest(sizes: DataFrame) -> tuple[int, int]:
    """The number of all rows, and that of the heaviest key, from keys with their number of rows n."""
    told = sizes.agg(F.sum("n").alias("all"), F.max("n").alias("most")).first()
    return told["all"] or 0, told["most"] or 0


def joined(rows: DataFrame, table: DataFrame, keys: list[str], sizes: DataFrame | None = None, how: str = "inner", told: tuple[int, int] | None = None) -> DataFrame:
    """rows joined with a table that has each key once; no task gets all rows of a heavy key.

    A key is heavy if it has more than HEAVY rows and more than one in MOST of all: there can't
    be more than MOST of these, so their part of the table is broadcast, and only the others'
    rows are shuffled. sizes: the keys with their number of rows n, if that is known, and told:
    its heaviest(). Both may be rough: they decide how rows travel, not which meet.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")) if sizes is None else sizes.select(*keys, "n")
    total, most = told or heaviest(sizes)
    least = max(HEAVY, -(-total // MOST))
    if most <= least:
        return rows.join(table, keys, how)
    heavy = sizes.where(F.col("n") > least).select(*keys)
    marked = rows.join(F.broadcast(heavy.withColumn("__heavy", F.lit(True))), keys, "left")
    few = F.broadcast(table.join(F.broadcast(heavy), keys, "left_semi"))
    light, dense = marked.where("__heavy IS NULL").drop("__heavy"), marked.where("__heavy").drop("__heavy")
    return light.join(table, keys, how).unionByName(dense.join(few, keys, how))


def marked(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows whose number in ``column`` is one of ids, which has that column too.

    Numbers that monotonically_increasing_id() gave lie close together, so ids are kept as bits, 64
    to a word. Up to MARKS words (67 million rows if most are marked) are broadcast, and rows stay
    where they are; more words meet the rows by shuffle.
    """
    bits = ids.groupBy(F.shiftright(column, 6).alias("__word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({column} & 63 AS int))")).alias("__bits"))
    bits = stored(bits, "marks")
    bits = F.broadcast(bits) if bits.count() <= MARKS else bits
    among = (F.shiftright(column, 6) == F.col("__word")) & (F.expr(f"getbit(__bits, cast({column} & 63 AS int))") == 1)
    return rows.join(bits, among, "left_semi")


def in_blocks(rows: DataFrame, group: str, node: str, size: str, centre: str, block: int = BLOCK) -> DataFrame:
    """Deals each group's rows to blocks (group, i, j = i) of about ``block`` rows, each once; the
    group's centre (a boolean column) goes to all of its blocks.

    Groups of at most a block are thus together in one task; a larger group's blocks each meet
    the centre, which joins most of what is alike in time linear in the group. What is left is
    for across(). ``size`` is the column with the group's number of rows.
    """
    n = F.ceil(F.col(size) / block).cast("int")
    mine = F.pmod(F.xxhash64(F.lit(77), node), n).cast("int")
    names = [c for c in rows.columns if c not in (size, centre)]
    out = rows.withColumn("i", F.explode(F.when(F.col(centre) & (n > 1), F.sequence(F.lit(0), n - 1)).otherwise(F.array(mine))))
    return _dealt(out.select(*names, "i", F.col("i").alias("j"), F.lit(True).alias("left")), group)


def across(rows: DataFrame, group: str, node: str, block: int = BLOCK) -> DataFrame:
    """Deals groups' rows to block tasks (group, i, j) so that any two rows with different labels
    meet in one, but for those of a group's main label, which don't need each other.

    Columns: ``label``; ``main``, the label that most of the group's rows have; ``n_main`` and
    ``size``, its and all rows. A group with o rows of other labels has about o / block *
    size / block tasks of at most two blocks each. ``left`` tells whether a row is of block i.
    """
    others, mains = (F.ceil(n / block).cast("int") for n in (F.col("size") - F.col("n_main"), F.col("n_main")))
    is_main = F.col("label") == F.col("main")
    k = F.pmod(F.xxhash64(F.lit(78), node), F.when(is_main, mains).otherwise(others)).cast("int")
    task = lambda i, j, left: F.struct(i.alias("i"), j.alias("j"), left.alias("left"))
    each_other, each_main = F.sequence(F.lit(0), others - 1), F.sequence(others, others + mains - 1)
    of_main = F.transform(each_other, lambda o: task(o, others + k, F.lit(False)))
    of_other = F.concat(F.transform(each_other, lambda o: task(F.least(o, k), F.greatest(o, k), k <= o)), F.transform(each_main, lambda m: task(k, m, F.lit(True))))
    names = [c for c in rows.columns if c not in ("main", "n_main", "size")]
    out = rows.withColumn("__t", F.explode(F.when(is_main, of_main).otherwise(of_other)))
    return _dealt(out.select(*names, "__t.i", "__t.j", "__t.left"), group)


def _dealt(tasks: DataFrame, group: str) -> DataFrame:
    return tasks.repartition(group, "i", "j").sortWithinPartitions(group, "i", "j")


def main_labels(rows: DataFrame, group: str) -> DataFrame:
    """group, main, n_main and size of the groups that have several labels, from (group, label)."""
    counts = rows.groupBy(group, "label").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy(group).agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("size"))
    return sizes.where("n_main < size")


def stars(adjacent: np.ndarray) -> list[tuple[int, int]]:
    """(least, member) for the members of each component of a symmetric boolean matrix."""
    seen, edges = ~adjacent.any(axis=0), []
    for s in range(len(adjacent)):
        if seen[s]:
            continue
        seen[s], front = True, np.array([s])
        while len(front):
            front = np.flatnonzero(adjacent[front].any(axis=0) & ~seen)
            edges += [(s, k) for k in front.tolist()]
            seen[front] = True
    return edges


def linked(tasks: DataFrame, group: str, alike: Callable[[pa.Table, pa.Table], np.ndarray]) -> DataFrame:
    """(a, b) long: for each block task the components of the rows that alike() finds alike, as
    stars around the least label. Tasks that find the same component thus give the same edges.

    tasks comes from in_blocks() or across() and has columns ``node`` and ``label``. Rows with equal labels
    are known to be connected; edges join labels, and a task never emits more than it has labels.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, (group, "i", "j")):
            labels, place = np.unique(np.asarray(t["label"]), return_inverse=True)
            if len(labels) < 2:
                continue
            left = np.asarray(t["left"])
            x = np.zeros((len(labels), len(labels)), dtype=bool)
            if t["i"][0].as_py() == t["j"][0].as_py():
                a, b = np.nonzero(alike(t, t))
                x[place[a], place[b]] = True
            else:
                one, two = t.filter(pa.array(left)), t.filter(pa.array(~left))
                if not one.num_rows or not two.num_rows:
                    continue
                a, b = np.nonzero(alike(one, two))
                p, q = place[left][a], place[~left][b]
                x[p, q] = x[q, p] = True
            np.fill_diagonal(x, False)
            if edges := stars(x):
                a, b = np.array(edges).T
                yield pa.RecordBatch.from_arrays([pa.array(labels[a]), pa.array(labels[b])], names=["a", "b"])

    return tasks.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, label) for every node of an edge (a, b); the label is the least node of its component.

    Least labels go to neighbours, then each label is replaced by its own label's label; both
    are joins and aggregations, written to shared storage after each round. Paths shorten
    geometrically, so rounds grow with the logarithm of a component's diameter. Nodes with very
    many edges and labels of very many nodes are looked up by broadcast (joined()).
    """
    # A node that hangs on several roots keeps the least one, which takes the others over: equal
    # links between roots merge, and about one edge per node is left for the rounds.
    spark = edges.sparkSession
    low = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    low = low.withColumn("m", F.min("a").over(Window.partitionBy("b")))
    pairs = F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b").alias("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b"))))
    both = low.select(pairs.alias("e")).select("e.a", "e.b").where("a <> b").distinct()
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    both, edges_at = put(both.select(ways.alias("e")).select("e.a", "e.b"), "edges")
    degrees, degrees_at = put(both.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.least("a", F.min("b")).alias("label")), "degrees")
    labels, at = degrees.select(F.col("a").alias("node"), "label"), degrees_at
    # both has each edge in both directions, so b has as many rows as a. A label is held by neighbours at first.
    sizes = degrees.select(F.col("a").alias("b"), "n")
    edges_told = told = heaviest(sizes)
    if not told[0]:
        return labels
    for _ in range(most):
        near = joined(both, labels.select(F.col("node").alias("b"), "label"), ["b"], sizes, told=edges_told)
        near = near.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        held = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
        after = joined(step, labels.select(F.col("node").alias("label"), F.col("label").alias("far")), ["label"], held, told=told)
        after = after.select("node", F.least("label", "far").alias("label"), (F.least("label", "far") != F.col("old")).alias("moved"))
        before = at
        after, at = put(after, "labels")
        if before != degrees_at:
            erase(spark, before)
        labels = after.select("node", "label")
        seen = after.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.bool_or("moved").alias("moved"))
        seen = seen.agg(F.sum("n").alias("all"), F.max("n").alias("most"), F.bool_or("moved").alias("moved")).first()
        if not seen["moved"]:
            erase(spark, edges_at), erase(spark, degrees_at)
            return labels
        told = seen["all"], seen["most"]
    raise RuntimeError(f"components did not settle in {most} rounds")
