"""Structured Streaming forms of the time-based operators. Each works on a batch as on a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunked(df: DataFrame, time: str, keys: Sequence[str], length: str = "1 hour", value: str = "value", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of fixed time chunks of each key; rows later than ``late`` are left out."""
    rows = df.withWatermark(time, late) if df.isStreaming else df
    return rows.groupBy(F.window(time, length).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(
        *keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total"
    )


def packet_segments(df: DataFrame, time: str, keys: Sequence[str], gap: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Segments of packets that gaps separate, as session windows."""
    rows = df.withWatermark(time, late) if df.isStreaming else df
    return rows.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), "n")


def without_repeats(df: DataFrame, time: str, keys: Sequence[str], late: str = "10 minutes") -> DataFrame:
    """Packets that were sent twice count once, within the watermark."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys)) if df.isStreaming else df.dropDuplicates(list(keys))
