"""Spectra in tables: headers and values of power spectra, saved, read and checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeframe.sources.tables import condition
from quakeframe.state import LIVE, kill_if, with_state

COLUMNS = {"f0": "double", "df": "double", "nf": "long", "spectrum_type": "string", "spectrum": "array<double>"}


def verified(df: DataFrame) -> DataFrame:
    """Rows that are no spectrum die: values missing or not finite, a wrong count, a step not above zero."""
    bad = F.coalesce((F.col("df") <= 0) | (F.size("spectrum") != F.col("nf")) | F.exists("spectrum", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))
    return kill_if(with_state(df), bad, "spectra", "no valid spectrum")


def save_spectra(df: DataFrame, path: str, data_tag: str = "all", mode: str = "append") -> None:
    """Live spectra under ``path`` by data_tag, the values as the last column."""
    rows = verified(df).filter(LIVE)
    head = [F.col(c) for c in rows.columns if c not in (*COLUMNS, LIVE, "elog", "data_tag")]
    own = [F.col(c).cast(kind).alias(c) for c, kind in COLUMNS.items()]
    rows.select(*head, F.lit(data_tag).alias("data_tag"), *own).write.mode(mode).partitionBy("data_tag").parquet(path)


def read_spectra(spark: SparkSession, path: str, data_tag: str | None = None, query: dict | None = None) -> DataFrame:
    """Spectra of a tag that fit a document filter."""
    df = spark.read.parquet(path)
    df = df.filter(F.col("data_tag") == data_tag) if data_tag is not None else df
    return df.filter(condition(query)) if query else df


def save_arrival_snr(arrivals: DataFrame, metrics: DataFrame, key: str = "arrival_id", use_measured_time: bool = False) -> DataFrame:
    """Arrivals with the signal-to-noise metrics measured at them as a struct ``Parrival``; with
    ``use_measured_time`` the measured time replaces the arrival's. Of metrics that repeat a key the
    largest signal-to-noise counts; arrivals without any keep a null."""
    names = [c for c in metrics.columns if c != key]
    best = metrics.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(*[c for c in ("snr_median", *names) if c in names])).alias("Parrival"))
    out = arrivals.join(best, key, "left")
    if use_measured_time and "time" in names:
        out = out.withColumn("time", F.coalesce("Parrival.time", "time"))
    return out
