"""Daily activity by event type; the same plan for a table and for a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily(events: DataFrame, late: str = "2 days") -> DataFrame:
    """window, event_type, n, total; a stream's state is dropped `late` behind the newest event."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def upsert(batch: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """A table with the rows of a batch in place of those of equal keys, for foreachBatch."""
    return table.join(batch.select(*keys).distinct(), keys, "left_anti").unionByName(batch)
