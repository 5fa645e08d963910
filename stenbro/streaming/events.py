"""Streams of events: windowed counts with late data, and dropping of repeats, over any streaming source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, ts: str, by: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per window and kind; rows later than the watermark are left out. Works on batches alike."""
    marked = events.withWatermark(ts, late) if events.isStreaming else events
    counted = marked.groupBy(F.window(ts, window).alias("w"), by).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), by, "n")


def without_repeats(events: DataFrame, keys: list[str], ts: str, late: str = "2 hours") -> DataFrame:
    """Each key once; on a stream, within the watermark."""
    if events.isStreaming:
        return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)
