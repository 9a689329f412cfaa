"""Task events as streams: windowed counts with late data, and events deduplicated within a watermark. Extensions to the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, at: str = "ts", kind: str = "event_type", size: str = "24 hours", late: str = "1 hour") -> DataFrame:
    """(start, kind, n) of tumbling windows; the same for streams, where windows close ``late`` after their end."""
    timed = events.withColumn("_at", F.col(at).cast("timestamp"))
    timed = timed.withWatermark("_at", late) if events.isStreaming else timed
    counts = timed.groupBy(F.window("_at", size).alias("w"), kind).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), kind, "n")


def once(events: DataFrame, key: str, at: str = "ts", late: str = "1 hour") -> DataFrame:
    """Events without repeats of a key; in streams within the watermark."""
    if not events.isStreaming:
        return events.dropDuplicates([key])
    return events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late).dropDuplicatesWithinWatermark([key]).drop("_at")
