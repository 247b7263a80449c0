"""The SQL engine: keyed tables over a mutation log, queries planned by Spark."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators.dml import absent, matches, merged
from .operators.lww import latest
from .plans import parser as p
from .plans.lexer import statements
from .sources.log import Log
from .spec import DELETED, SEQ, TS, PartitionKeyError, TableError, TableSpec

MUTATION = "op string, unit string, count long"


class Engine:
    """Tables under ``root``. strict=True refuses statements that don't bind the leading key.

    Statements of one engine run one after the other, so a conditional write reads and appends
    under one lock; engines in other processes are not kept apart. With ``buffer`` rows of
    memory, mutations of single statements gather per table and become one segment when there
    are so many of them, or at flush(); until then a crash loses them. Without, each statement
    writes a segment.
    """

    def __init__(self, spark: SparkSession, root: str, strict: bool = False, clock: Callable[[], int] | None = None, buffer: int = 0) -> None:
        self.spark, self.log, self.strict, self.buffer = spark, Log(spark, root), strict, buffer
        self.pending: dict[str, list[tuple]] = {}
        self.clock = clock or (lambda: time.time_ns() // 1000)
        self.lock, self.sequence = threading.RLock(), 0
        self.tables: dict[str, tuple[TableSpec, int]] = {}
        self._load()

    # --- catalog ---

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.log.root}/_tables/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _load(self) -> None:
        path, fs = self._file("")
        if not fs.exists(path):
            return
        for line in self.spark.read.text(f"{self.log.root}/_tables/*").collect():
            d = json.loads(line[0])
            self.tables[d["name"]] = TableSpec(d["name"], tuple(d["partition"]), tuple(d["clustering"]), T.StructType.fromJson(d["schema"])), d["generation"]

    def _save(self, name: str) -> None:
        path, fs = self._file(name)
        if name not in self.tables:
            fs.delete(path, False)
            return
        spec, generation = self.tables[name]
        # Written beside and renamed: a crash leaves the old definition or the new one.
        new, _ = self._file(f".{name}.new")
        text = json.dumps({"name": name, "partition": spec.partition, "clustering": spec.clustering, "schema": spec.schema.jsonValue(), "generation": generation})
        out = fs.create(new, True)
        out.write(bytearray(text.encode()))
        out.close()
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        how = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        how[0] = hadoop.Options.Rename.OVERWRITE
        hadoop.FileContext.getFileContext(path.toUri(), self.spark._jsc.hadoopConfiguration()).rename(new, path, how)

    def spec(self, name: str) -> TableSpec:
        if name not in self.tables:
            raise TableError(f"no table {name}")
        return self.tables[name][0]

    def table(self, name: str) -> DataFrame:
        """The newest rows of a table, buffered ones included."""
        spec = self.spec(name)
        held = self.pending.get(name)
        return self.log.rows(spec, self.tables[name][1], self.spark.createDataFrame(held, spec.log_schema) if held else None)

    def flush(self, name: str | None = None) -> None:
        """Writes what is buffered, of one table or all, as segments sorted by key."""
        with self.lock:
            for one in [name] if name else list(self.pending):
                if held := self.pending.pop(one, None):
                    spec = self.spec(one)
                    rows = self.spark.createDataFrame(held, spec.log_schema).coalesce(1).sortWithinPartitions(*spec.keys, TS, SEQ)
                    self.log.append(spec, self.tables[one][1], rows)

    # --- statements ---

    def sql(self, text: str, ts: int | None = None) -> DataFrame:
        """Runs all statements of a text; the result of the last. ts: the version, in microseconds."""
        out = self._rows([], "")
        with self.lock:
            for one in statements(text):
                out = self._run(p.parse(one), self.clock() if ts is None else ts)
        return out

    def _rows(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema or T.StructType([]))

    def _told(self, op: str, n: int) -> DataFrame:
        return self._rows([(op, "row", n)], MUTATION)

    def _run(self, s, ts: int) -> DataFrame:
        if isinstance(s, p.Select):
            return self._select(s)
        if isinstance(s, p.ShowTables):
            return self._rows([(n,) for n in sorted(self.tables)], "tableName string")
        if isinstance(s, p.Create):
            if s.spec.name in self.tables:
                if s.if_not_exists:
                    return self._rows([("CREATE TABLE", "table", 0)], MUTATION)
                raise TableError(f"table {s.spec.name} exists")
            self.tables[s.spec.name] = s.spec, self._fresh(s.spec.name)
            self._save(s.spec.name)
            return self._rows([("CREATE TABLE", "table", 1)], MUTATION)
        if isinstance(s, p.Drop):
            if s.table not in self.tables and not s.if_exists:
                raise TableError(f"no table {s.table}")
            dropped = self.tables.pop(s.table, None)
            self.pending.pop(s.table, None)
            self._save(s.table)
            return self._rows([("DROP TABLE", "table", int(dropped is not None))], MUTATION)
        if isinstance(s, p.Truncate):
            spec = self.spec(s.table)
            self.pending.pop(s.table, None)
            self.tables[s.table] = spec, self._fresh(s.table)
            self._save(s.table)
            return self._rows([("TRUNCATE", "table", 1)], MUTATION)
        if isinstance(s, p.Insert):
            return self._insert(s, ts)
        if isinstance(s, p.Update):
            return self._update(s, ts)
        if isinstance(s, p.Delete):
            return self._delete(s, ts)
        raise TableError(f"cannot run {s}")

    def _fresh(self, name: str) -> int:
        """A generation that no earlier table of the name has used."""
        return max(time.time_ns() // 1000, self.tables[name][1] + 1 if name in self.tables else 0)

    def _append(self, spec: TableSpec, rows: DataFrame, ts: int, deleted: bool = False, single: bool = True) -> None:
        self.sequence += 1
        seq = F.lit((time.time_ns() // 1000 << 8) + self.sequence % 256).cast("long")
        full = rows.select(*[F.col(c).cast(spec.schema[c].dataType).alias(c) if c in rows.columns else F.lit(None).cast(spec.schema[c].dataType).alias(c) for c in spec.columns])
        full = full.withColumn(TS, F.lit(ts).cast("long")).withColumn(SEQ, seq).withColumn(DELETED, F.lit(deleted))
        if not self.buffer or not single:
            self.log.append(spec, self.tables[spec.name][1], full)
            return
        held = self.pending.setdefault(spec.name, [])
        held += map(tuple, full.select(*spec.log_schema.names).collect())  # the rows of one statement's text
        if len(held) >= self.buffer:
            self.flush(spec.name)

    def _values(self, spec: TableSpec, columns: list[str], rows: list[list]) -> DataFrame:
        if unknown := [c for c in columns if c not in spec.columns]:
            raise TableError(f"{spec.name} has no columns {unknown}")
        if missing := [k for k in spec.keys if k not in columns]:
            raise PartitionKeyError(f"{spec.name}: key columns {missing} are missing")
        if any(len(r) != len(columns) for r in rows):
            raise TableError("a row has another number of values than there are columns")
        if any(v is None for r in rows for c, v in zip(columns, r, strict=True) if c in spec.keys):
            raise TableError("key columns can't be null")
        # Of equal keys within a statement the last row holds.
        held = {tuple(r[columns.index(k)] for k in spec.keys): r for r in rows}
        text = [tuple(None if v is None else str(v).lower() if isinstance(v, bool) else str(v) for v in r) for r in held.values()]
        raw = self.spark.createDataFrame(text, ", ".join(f"`{c}` string" for c in columns))
        return raw.select(*[F.col(c).cast(spec.schema[c].dataType).alias(c) for c in columns])

    def _insert(self, s: p.Insert, ts: int) -> DataFrame:
        spec = self.spec(s.table)
        if s.query is not None:
            found = self._select(p.parse(s.query))
            rows = found.toDF(*(s.columns or spec.columns))
            if missing := [k for k in spec.keys if k not in rows.columns]:
                raise PartitionKeyError(f"{spec.name}: key columns {missing} are missing")
            # A query has no order, so of equal keys the row with the greatest values holds. It runs
            # once: the rows are counted as they are written.
            rest = [c for c in rows.columns if c not in spec.keys]
            seen = Observation()
            rows = latest(rows, spec.keys, rest or spec.keys).observe(seen, F.count(F.lit(1)).alias("n"))
            self._append(spec, rows, ts, single=False)
            return self._told("INSERT", seen.get["n"])
        rows = self._values(spec, s.columns or spec.columns, s.rows)
        if s.if_not_exists:
            free = not absent(rows, self.table(s.table), spec.keys).isEmpty()
            if free:
                self._append(spec, rows, ts)
            return self._rows([(str(free).lower(),)], "`[applied]` string")
        self._append(spec, rows, ts)
        return self._told("INSERT", len(s.rows))

    def _key_row(self, spec: TableSpec, where: dict) -> DataFrame:
        if sorted(where) != sorted(spec.keys):
            raise PartitionKeyError(f"{spec.name}: exactly the key columns {list(spec.keys)} must be bound")
        return self._values(spec, list(where), [list(where.values())])

    def _update(self, s: p.Update, ts: int) -> DataFrame:
        spec = self.spec(s.table)
        if unknown := [c for c in [*s.assign, *(s.expect or {})] if c not in spec.columns]:
            raise TableError(f"{spec.name} has no columns {unknown}")
        key = self._key_row(spec, s.where)
        current = self.table(s.table).join(key, list(spec.keys), "left_semi")
        if s.expect is not None:
            rows = current.withColumn("__ok", matches(current, s.expect)).take(1)
            if not rows or not rows[0]["__ok"]:
                held = {c: rows[0][c] if rows else None for c in s.expect}
                return self._rows([("false", *[None if v is None else str(v) for v in held.values()])], ", ".join(["`[applied]` string", *[f"`{c}` string" for c in held]]))
        assign = {c: F.lit(v).cast(spec.schema[c].dataType) for c, v in s.assign.items() if c not in spec.keys}
        self._append(spec, merged(key, current, spec.keys, assign, spec.columns), ts)
        return self._told("UPDATE", 1) if s.expect is None else self._rows([("true",)], "`[applied]` string")

    def _delete(self, s: p.Delete, ts: int) -> DataFrame:
        spec = self.spec(s.table)
        self._append(spec, self._key_row(spec, s.where), ts, deleted=True)
        return self._told("DELETE", 1)

    def _select(self, s: p.Select) -> DataFrame:
        for name in s.tables:
            if name not in self.tables:
                continue
            spec = self.spec(name)
            if self.strict and not (s.counts and not s.bound) and spec.partition[0] not in s.bound:
                raise PartitionKeyError(f"{name}: the partition key {spec.partition[0]} must be bound")
            self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(s.text)

    def delete_prefix(self, name: str, ts: int | None = None, **prefix) -> int:
        """Deletes all rows with the given leading key columns; how many there were."""
        spec = self.spec(name)
        if not prefix or list(prefix) != list(spec.keys[: len(prefix)]):
            raise PartitionKeyError(f"{name}: leading key columns of {list(spec.keys)} must be bound, in order")
        with self.lock:
            rows, seen = self.table(name), Observation()
            for k, v in prefix.items():
                rows = rows.where(F.col(k) == F.lit(v))
            self._append(spec, rows.select(*spec.keys).observe(seen, F.count(F.lit(1)).alias("n")), self.clock() if ts is None else ts, deleted=True, single=False)
        return seen.get["n"]

    def register(self, name: str, function: Callable, returns: str) -> None:
        """Makes a function over Arrow arrays callable in SELECTs."""
        self.spark.udf.register(name, F.arrow_udf(function, returns))

    def partition_keys(self, text: str) -> list[str]:
        """Key columns that a SELECT binds, in key order."""
        s = p.parse(text)
        return [k for name in s.tables if name in self.tables for k in self.spec(name).keys if k in s.bound]

    def compact(self, name: str) -> None:
        """Replaces a table's segments by its newest rows, sorted by key."""
        with self.lock:
            self.flush(name)
            spec, generation = self.tables[name]
            self.log.compact(spec, generation)
            self.tables[name] = spec, generation + 1
            self._save(name)
