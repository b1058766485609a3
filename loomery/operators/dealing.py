"""How rows are dealt over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def dealt(frame: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """``frame`` over all shuffle partitions by ``key``, or over as many as hold ``most`` rows each on average, if
    that is more (its rows are counted first).

    For small rows on which much is computed, as the few tasks that read a small file would do all of
    it; and for joins and groups by ``key``, which keep these partitions, so that none of their tasks grows.
    """
    parts = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return frame.repartition(max(parts, -(-frame.count() // most)) if most else parts, key)
