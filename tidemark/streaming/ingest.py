"""Continuous ingest: micro-batches of mutations go to the log, readers resolve versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.lww import latest


def ingest(stream: DataFrame, log: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Appends each micro-batch as one segment. ``every``: a trigger interval, else all there is.

    A segment's path holds its batch number and is overwritten, so a batch that runs again after
    a failure leaves no second copy.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/batch={number}")

    out = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def resolved(log: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest version of each key; late writes lose by their own time."""
    return latest(log, keys, order)


def live_latest(stream: DataFrame, keys: Sequence[str], ts: str, values: Sequence[str], late: str | None = None) -> DataFrame:
    """The newest values per key as a streaming aggregate (update mode). ``late`` bounds its state
    by a watermark; without it state grows with the number of keys."""
    rows = stream.withWatermark(ts, late) if late else stream
    return rows.groupBy(*keys).agg(F.max(ts).alias(ts), *[F.max_by(v, ts).alias(v) for v in values])


def windowed_counts(stream: DataFrame, ts: str, width: str, slide: str, by: Sequence[str], late: str) -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width, slide), *by).agg(F.count(F.lit(1)).alias("n"))
