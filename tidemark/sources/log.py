"""The mutation log: Parquet segments per table and generation, and text logs in base64."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.lww import latest
from ..spec import DELETED, SEQ, TS, TableSpec


class Log:
    """Appends mutations and resolves them. A truncated table gets a new generation."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str, generation: int) -> str:
        return f"{self.root}/{table}/g{generation}"

    def append(self, spec: TableSpec, generation: int, rows: DataFrame) -> None:
        rows.select(*spec.log_schema.names).write.mode("append").parquet(self.path(spec.name, generation))

    def mutations(self, spec: TableSpec, generation: int) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(spec.name, generation))
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], spec.log_schema)
        return self.spark.read.schema(spec.log_schema).parquet(self.path(spec.name, generation))

    def rows(self, spec: TableSpec, generation: int, more: DataFrame | None = None) -> DataFrame:
        """The newest row of each key, of the log and of mutations that aren't in it yet."""
        all_ = self.mutations(spec, generation)
        return latest(all_.unionByName(more) if more is not None else all_, spec.keys, [TS, SEQ], DELETED).select(*spec.columns)

    def compact(self, spec: TableSpec, generation: int, partitions: int | None = None) -> None:
        """Writes the newest versions, sorted by key, as generation + 1; readers switch afterwards.

        Range partitions keep keys together, so a file's statistics cover a narrow span.
        """
        newest = latest(self.mutations(spec, generation), spec.keys, [TS, SEQ]).where(~F.col(DELETED))
        by = [F.col(k) for k in spec.keys]
        dealt = newest.repartitionByRange(partitions, *by) if partitions else newest.repartitionByRange(*by)
        out = dealt.sortWithinPartitions(*spec.keys).write.mode("overwrite")
        for k in spec.partition:
            out = out.option(f"parquet.bloom.filter.enabled#{k}", "true")
        out.parquet(self.path(spec.name, generation + 1))


def replay_text_log(lines: DataFrame) -> DataFrame:
    """(nth, key, payload) of lines ``key TAB base64``, in log order; a bad line raises an error."""
    parts = F.split("value", "\t", 2)
    return lines.select(F.element_at(parts, 1).alias("key"), F.to_binary(F.element_at(parts, 2), F.lit("base64")).cast("string").alias("payload"))


def to_text_log(df: DataFrame, key: str, payload: str) -> DataFrame:
    return df.select(F.concat_ws("\t", F.col(key), F.base64(F.encode(F.col(payload), "UTF-8"))).alias("value"))


def encode_row(columns: list[str]) -> F.Column:
    """A row as JSON text, nulls left out."""
    return F.to_json(F.struct(*columns))


def decode_row(text: str | F.Column, schema: T.StructType | str) -> F.Column:
    return F.from_json(text, schema)


def version(ts: F.Column, payload: F.Column) -> F.Column:
    """A version as bytes: eight of time, most significant first, then the payload."""
    return F.concat(F.unhex(F.lpad(F.hex(ts), 16, "0")), F.encode(payload, "UTF-8"))


def split_version(cell: F.Column) -> F.Column:
    """struct(ts, payload) of a version; a cell of under eight bytes is all payload, at time 0."""
    short = F.octet_length(cell) < 8
    ts = F.conv(F.hex(F.substring(cell, 1, 8)), 16, 10).cast("long")
    rest = F.substring(cell, F.lit(9), F.greatest(F.octet_length(cell) - 8, F.lit(0)))
    return F.struct(F.when(short, F.lit(0).cast("long")).otherwise(ts).alias("ts"), F.decode(F.when(short, cell).otherwise(rest), "UTF-8").alias("payload"))
