"""Ingest in two phases: a placeholder for every file that is seen, then what was read from it.

A micro-batch writes its placeholders first and its records after that, each in a folder of the
batch's number. A run that stops between the two leaves placeholders without records; started
again from its checkpoint, the stream runs the same batch under the same number, which overwrites
both. Readers see each key's newest row, so a file shows as pending until its record is there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: States of a row.
PENDING, COMPLETE, ERROR = "pending", "complete", "error"


def start(stream: DataFrame, target: str, checkpoint: str, key: str, parse: Callable[[DataFrame], DataFrame], between: Callable[[int], None] | None = None):
    """Starts the ingest of ``stream`` into ``target``. ``parse`` makes records (``key`` and what is read, null
    where nothing could be); ``between`` is called with the batch's number after its first phase."""

    def write(batch: DataFrame, number: int) -> None:
        seen = batch.dropDuplicates([key]).persist()
        try:
            seen.select(key).write.mode("overwrite").parquet(f"{target}/placeholders/batch={number}")
            if between:
                between(number)
            parse(seen).write.mode("overwrite").parquet(f"{target}/records/batch={number}")
        finally:
            seen.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _batches(spark: SparkSession, folder: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return spark.read.option("mergeSchema", "true").parquet(folder) if files.exists(path) else None


def state(spark: SparkSession, target: str, key: str, value: str, interrupted: bool = False) -> DataFrame:
    """Each key with its newest ``value`` and ``status``: pending while only its placeholder is there, error where
    it was read in vain. ``interrupted``: no run will end what is pending, so that is an error too."""
    seen, read = _batches(spark, f"{target}/placeholders"), _batches(spark, f"{target}/records")
    rows = seen.select(key, "batch", F.lit(0).alias("phase"), F.lit(PENDING).alias("status"))
    if read is not None:
        done = read.select(key, "batch", F.lit(1).alias("phase"), F.when(F.col(value).isNull(), ERROR).otherwise(COMPLETE).alias("status"), value)
        rows = rows.unionByName(done, allowMissingColumns=True)
    else:
        rows = rows.withColumn(value, F.lit(None).cast("string"))
    last = rows.groupBy(key).agg(F.max_by(F.struct("status", value), F.struct("batch", "phase")).alias("r"))
    status = F.when((F.col("r.status") == PENDING) & F.lit(interrupted), ERROR).otherwise(F.col("r.status"))
    return last.select(key, F.col(f"r.{value}").alias(value), status.alias("status"))
