"""Incremental ingest and activity counters with Structured Streaming.

Rows later than ``LATE`` behind the newest event time are dropped by the watermark, which bounds
the state; results are appended once a window is past it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LATE = "1 day"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share, under ``spark.checkpoint.dir``; on one machine, where
    that is unset, under the system's temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-")
    return f"{path}/{name}-{uuid.uuid4().hex}"


def source(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the Parquet files under ``path``."""
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader
    return reader.parquet(path)


def daily_counts(events: DataFrame) -> DataFrame:
    """Events of each kind by day."""
    marked = events.withWatermark("ts", LATE) if events.isStreaming else events
    out = marked.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("day"), "event_type", "n")


def sliding_counts(events: DataFrame, size: str = "6 hours", step: str = "2 hours") -> DataFrame:
    marked = events.withWatermark("ts", LATE) if events.isStreaming else events
    out = marked.groupBy(F.window("ts", size, step).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "2 hours") -> DataFrame:
    """Visits of each user: events less than ``gap`` apart."""
    marked = events.withWatermark("ts", LATE) if events.isStreaming else events
    out = marked.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def deduplicated(events: DataFrame, key: str = "event_id") -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withWatermark("ts", LATE).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def ingest(stream: DataFrame, target: str, checkpoint: str, key: str, prepare=lambda df: df):
    """Starts an ingest: each micro-batch is prepared, deduplicated by key and appended under its
    batch number, so that a batch that is run again after a failure overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        prepare(batch).dropDuplicates([key]).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(ingested: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows that several batches ingested, the newest of each key."""
    return ingested.groupBy(key).agg(F.max_by(F.struct(*(c for c in ingested.columns if c != key)), F.struct(F.col(order))).alias("r")).select(key, "r.*")
