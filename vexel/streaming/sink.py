"""Streams into collections, and windowed counts of event streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vexel.plans.collection import Collection
from vexel.sources import storage


def _once(collection: Collection, checkpoint: str, name: str, apply: Callable[[DataFrame, tuple[str, int]], object]) -> Callable[[DataFrame, int], None]:
    """Applies a micro-batch unless the collection's manifest holds it as applied, so that a repeated batch changes nothing.

    The batch's number is committed in the version that has its rows, under the stream's own id, which a fresh checkpoint
    has anew.
    """

    def run(batch: DataFrame, number: int) -> None:
        stream = f"{name}:{storage.read_json(collection.spark, f'{checkpoint}/metadata')['id']}"
        if collection.manifest.get("applied", {}).get(stream, -1) < number and not batch.isEmpty():
            apply(batch, (stream, number))

    return run


def upsert_stream(source: DataFrame, collection: Collection, checkpoint: str, name: str = "upsert", seq: str | None = None, available_now: bool = True, every: str = "10 seconds") -> StreamingQuery:
    """Each micro-batch as an upsert; with the checkpoint, every row takes effect once."""
    writer = source.writeStream.foreachBatch(_once(collection, checkpoint, name, lambda b, mark: collection.upsert(b, seq, mark=mark))).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def insert_stream(source: DataFrame, collection: Collection, checkpoint: str, name: str = "insert", available_now: bool = True, every: str = "10 seconds") -> StreamingQuery:
    """Each micro-batch appended once, expiry and sparse vectors included."""
    writer = source.writeStream.foreachBatch(_once(collection, checkpoint, name, lambda b, mark: collection.insert(b, mark=mark))).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def windowed_counts(events: DataFrame, time: str, by: str, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(window_start, by, events): counts in tumbling or sliding windows; rows later than ``late`` are dropped in a stream."""
    w = F.window(F.col(time).cast("timestamp"), window, slide) if slide else F.window(F.col(time).cast("timestamp"), window)
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return rows.groupBy(w.alias("w"), by).agg(F.count("*").alias("events")).select(F.col("w.start").alias("window_start"), by, "events")
