"""Incremental runs over arriving files, and event-time windows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import removed_at_end, shared_dir


def process_new(spark: SparkSession, source: str, schema, handle: Callable[[DataFrame, int], None], checkpoint: str, per_batch: int = 1000) -> None:
    """Every file that arrived since the last run, in batches, once each; stops when none is left."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(source)
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upsert_into(path: str, key: str, newest: str) -> Callable[[DataFrame, int], None]:
    """A batch handler that writes the batch as a numbered delta; ``current`` reads the newest row of each key."""

    def handle(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c not in (key, newest)]
        latest = batch.groupBy(key).agg(F.max(F.struct(newest, *rest)).alias("r")).select(key, "r.*")
        latest.write.mode("overwrite").parquet(f"{path}/batch={number}")  # a repeated batch replaces itself

    return handle


def current(spark: SparkSession, path: str, key: str, newest: str) -> DataFrame:
    rows = spark.read.parquet(path).drop("batch")
    rest = [c for c in rows.columns if c not in (key, newest)]
    return rows.groupBy(key).agg(F.max(F.struct(newest, *rest)).alias("r")).select(key, "r.*")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; its parent is removed when the application ends."""
    parent = removed_at_end(spark, f"{shared_dir(spark).rstrip('/')}/folders-{spark.sparkContext.applicationId}")
    return f"{parent}/{name}-{uuid.uuid4().hex}"


def tumbling(events: DataFrame, time: str, size: str, late: str | None = None) -> DataFrame:
    """Counts and sums of ``value`` in windows of event time; rows later than ``late`` are left to the watermark."""
    rows = events.withWatermark(time, late) if late else events
    return rows.groupBy(F.window(time, size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("summe"))


def sliding(events: DataFrame, time: str, size: str, every: str) -> DataFrame:
    return events.groupBy(F.window(time, size, every).alias("w"), "event_type").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, time: str, user: str, gap: str) -> DataFrame:
    """Sessions of each user that end after a pause of ``gap``."""
    return events.groupBy(F.session_window(time, gap).alias("w"), user).agg(F.count("*").alias("n"))


def deduplicated(stream: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    """Repeated rows dropped as long as the watermark remembers them."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
