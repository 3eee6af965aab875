"""Event-time windows over curve cells, with a watermark: the streaming form of a histogram by curve cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import curves


def cell_counts(events: DataFrame, time: str, coords: list[str], k: int, cell_bits: int, window: str = "1 hour", late: str = "1 hour", name: str = "morton") -> DataFrame:
    """start, cell, n for each tumbling window; works on streams and on tables alike."""
    cell = F.shiftrightunsigned(curves.to_distance(name, [F.col(c) for c in coords], k), cell_bits)
    timed = events.withWatermark(time, late) if events.isStreaming else events
    return timed.groupBy(F.window(time, window).alias("w"), cell.alias("cell")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "cell", "n")
