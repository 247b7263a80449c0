"""Table definitions: names, keys and column types."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: Columns that the log adds to a table's own.
TS, SEQ, DELETED = "__ts", "__seq", "__deleted"

_TYPES = {
    "text": T.StringType(), "varchar": T.StringType(), "char": T.StringType(), "string": T.StringType(),
    "int": T.LongType(), "integer": T.LongType(), "bigint": T.LongType(), "smallint": T.LongType(), "unsigned": T.LongType(), "counter": T.LongType(),
    "float": T.DoubleType(), "double": T.DoubleType(), "real": T.DoubleType(), "decimal": T.DecimalType(38, 9), "numeric": T.DecimalType(38, 9),
    "boolean": T.BooleanType(), "bool": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampType(), "blob": T.BinaryType(),
}


class TableError(ValueError):
    """A statement that the table or the grammar doesn't allow."""


class PartitionKeyError(TableError):
    """A statement that would have to touch every partition, in strict mode."""


def identifier(name: str) -> str:
    """The last part of a possibly qualified or quoted name, in lower case."""
    return name.split(".")[-1].strip().strip('"`').lower()


def column_type(name: str) -> T.DataType:
    try:
        return _TYPES[name.lower()]
    except KeyError:
        raise TableError(f"unknown type {name}") from None


@dataclass(frozen=True)
class TableSpec:
    name: str
    partition: tuple[str, ...]
    clustering: tuple[str, ...]
    schema: T.StructType

    def __post_init__(self) -> None:
        if not self.partition:
            raise TableError(f"{self.name}: a primary key is required")
        if missing := [k for k in self.keys if k not in self.schema.names]:
            raise TableError(f"{self.name}: key columns {missing} are not declared")

    @property
    def keys(self) -> tuple[str, ...]:
        return self.partition + self.clustering

    @property
    def columns(self) -> list[str]:
        return self.schema.names

    @property
    def values(self) -> list[str]:
        return [c for c in self.columns if c not in self.keys]

    @property
    def log_schema(self) -> T.StructType:
        return T.StructType([*self.schema.fields, T.StructField(TS, T.LongType()), T.StructField(SEQ, T.LongType()), T.StructField(DELETED, T.BooleanType())])
