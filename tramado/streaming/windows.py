"""Streams: tumbling counts, sessions and first sightings with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, when: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts by window and keys; rows later than ``late`` behind the latest are dropped. Works on batches too."""
    w = events.withWatermark(when, late).groupBy(F.window(when, width), *keys).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("desde"), *keys, "n")


def sessions(events: DataFrame, when: str, gap: str, late: str, *keys: str) -> DataFrame:
    """Chains of events of one key with pauses under ``gap``: start, end, how many."""
    w = events.withWatermark(when, late).groupBy(F.session_window(when, gap), *keys).agg(F.count("*").alias("n"))
    return w.select(F.col("session_window.start").alias("desde"), F.col("session_window.end").alias("hasta"), *keys, "n")


def first_sightings(events: DataFrame, when: str, late: str, *ids: str) -> DataFrame:
    """Each id once within the watermark; state older than that is dropped."""
    return events.withWatermark(when, late).dropDuplicatesWithinWatermark(list(ids))
