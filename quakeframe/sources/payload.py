"""Headers of samples in files (``byterange`` reads and writes these), arrival times, catalogues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quakeframe.state import LIVE, kill_if, with_state


def header_offsets(df: DataFrame, keys: Sequence[str], order: Sequence[str], components: int = 3) -> DataFrame:
    """``foff`` and ``nbytes`` of records that follow one another in a file of doubles."""
    own = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    size = F.col("npts") * components * 8
    return df.withColumns({"foff": F.coalesce(F.sum(size).over(own), F.lit(0)), "nbytes": size})


def arrival_reference(df: DataFrame, key: str, start: float, end: float) -> DataFrame:
    """Times relative to an arrival, and the window about it; without the arrival a row dies."""
    from quakeframe.operators.window import window_data

    marked = kill_if(with_state(df), F.col(key).isNull(), "arrival_reference", f"{key} is missing")
    moved = marked.withColumns({"t0": F.when(F.col(LIVE), F.col("t0") - F.col(key)).otherwise(F.col("t0")), "t0shift": F.col(key)})
    return window_data(moved, start, end)


def flatten_catalog(events: DataFrame) -> DataFrame:
    """One source row an event: its preferred origin, else the first, and its first magnitude."""
    chosen = F.coalesce(F.get(F.filter("origins", lambda o: o["id"] == F.col("preferred")), F.lit(0)), F.get("origins", F.lit(0)))
    return events.withColumn("o", chosen).select("evid", F.col("o.lat").alias("lat"), F.col("o.lon").alias("lon"), F.col("o.depth").alias("depth"), F.col("o.time").alias("time"), F.get("magnitudes", F.lit(0)).alias("magnitude"))
