"""Debounce: one reindexing for each burst of changes of a path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def debounced(changes: DataFrame, *, gap: str = "500 milliseconds", watermark: str | None = None) -> DataFrame:
    """``path, first_ts, last_ts, n, last_seq`` for each burst.

    ``changes`` has ``path, ts, seq``.  A burst ends when a path is quiet for
    ``gap``.  Works on tables and, with a watermark, on streams, where a burst
    is emitted once the watermark has passed its end.
    """
    if watermark is not None:
        changes = changes.withWatermark("ts", watermark)
    bursts = changes.groupBy("path", F.session_window("ts", gap).alias("w")).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"), F.max_by("seq", F.struct("ts", "seq")).alias("last_seq")
    )
    return bursts.select("path", "first_ts", "last_ts", "n", "last_seq")
