"""Reading, shared storage and text helpers for the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import re
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: ASCII white space as the word rules define it; ``bytes.split()`` splits on exactly these.
SPACES = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where the setting is absent on one machine (tests) a temporary folder takes its place; on a
    cluster such a folder would be another one for each executor, so there its absence is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found


def put(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Cuts the lineage: writes the rows to the shared folder and reads them back; and their path.

    A written table outlives lost executors, and later reads prune its columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, tag: str) -> DataFrame:
    return put(df, tag)[0]


def erase(spark: SparkSession, path: str) -> None:
    """Removes a table that put() wrote and that no plan reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def process_memory(owner: str | None) -> dict:
    """What an operator remembers in a worker process from task to task.

    A process serves tasks of many operators. When another one begins, what the earlier one
    remembered is dropped. Each call gives back what is free. owner None: remembers nothing.
    """
    held = sys.modules.setdefault("_tidemark_memory", types.ModuleType("_tidemark_memory")).__dict__
    others = [k for k in held if k.startswith("of ") and k != f"of {owner}"]
    for k in others:
        del held[k]
    if others:
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library
    return held.setdefault(f"of {owner}", {}) if owner else {}


def map_arrow(df: DataFrame, schema: str | T.StructType, work: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None]) -> DataFrame:
    """Applies work to each Arrow batch; the schema is DDL text or a type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        process_memory(None)
        for batch in batches:
            out = work(batch)
            if out is None:
                continue
            yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return df.mapInArrow(run, schema)


def splitmix(x):
    """A 64-bit finaliser over a numpy uint64 array."""
    import numpy as np

    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64, copy=False)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
