"""Registration of queries: name, plan, and SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register f(t) -> DataFrame, where t(name) reads a table."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


#: Seconds since 1970 of a time-zone-free timestamp.
EPOCH = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {}) / 1e6"


def epoch(column: str):
    return F.expr(EPOCH.format(column))


def packets(t) -> DataFrame:
    """The events as packets of a station (user) and channel (type)."""
    return t("events").select(
        "event_id", F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("sta"), F.col("event_type").alias("chan"), epoch("ts").alias("time"), "value", "props"
    )


PACKETS = "p AS (SELECT event_id, 'U' || user_id AS sta, event_type AS chan, epoch_us(ts) / 1e6 AS time, value, props FROM events)"


def series(t) -> DataFrame:
    """The embeddings as series of 64 samples, t0 = 0 and dt = 0.5."""
    return t("embeddings").select("vec_id", "label", F.lit(0.0).alias("t0"), F.lit(0.5).alias("dt"), F.col("embedding").cast("array<double>").alias("data"))


SERIES = "s AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS data FROM embeddings)"


def rounded(c, digits: int = 6):
    return F.round(c, digits)
