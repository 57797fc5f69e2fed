"""Exact deduplication of a stream (an extension): the first of the events with equal keys within the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame


def deduplicated(stream: DataFrame, keys: list[str], time_field: str, delay: str = "1 hour") -> DataFrame:
    """State is kept for `delay` after a key was seen, so it does not grow with the stream."""
    return stream.withWatermark(time_field, delay).dropDuplicatesWithinWatermark(keys)
