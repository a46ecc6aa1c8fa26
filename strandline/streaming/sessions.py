"""Event-time sessions: the streaming form of operators.masks.sessionise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, keys: list[str], time_col: str, gap: str, late: str | None = None) -> DataFrame:
    """keys, start, end, events: runs of events of a key with less than gap between neighbours. late bounds the state of a stream."""
    source = events.withWatermark(time_col, late) if late else events
    out = source.groupBy(*keys, F.session_window(time_col, gap).alias("w")).agg(F.count("*").alias("events"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")
