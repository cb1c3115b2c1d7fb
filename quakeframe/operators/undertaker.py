"""Splitting off the dead."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakeframe.state import ELOG, LIVE, with_state


def bring_out_your_dead(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(live rows, dead rows)."""
    df = with_state(df)
    return df.filter(LIVE), df.filter(~F.col(LIVE))


def cremate(df: DataFrame) -> DataFrame:
    """The live rows; of the others no trace stays."""
    return with_state(df).filter(LIVE)


def cemetery(df: DataFrame, data: str = "data", data_tag: str | None = None) -> DataFrame:
    """A record for each dead row: its log, and its attributes without samples as the tombstone."""
    df = with_state(df).filter(~F.col(LIVE))
    kept = [c for c in df.columns if c not in (data, LIVE, ELOG)]
    return df.select(F.col(ELOG).alias("logdata"), F.to_json(F.struct(*kept)).alias("tombstone"), F.lit(data_tag).cast("string").alias("data_tag"))


def bury(df: DataFrame, data: str = "data", data_tag: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(live rows, cemetery records)."""
    return cremate(df), cemetery(df, data, data_tag)


def mummify(df: DataFrame, data: str = "data") -> DataFrame:
    """Dead rows without their samples."""
    df = with_state(df)
    return df.withColumn(data, F.when(F.col(LIVE), F.col(data)).otherwise(F.array().cast(df.schema[data].dataType)))


def abortions(df: DataFrame, kind: str) -> DataFrame:
    """Records of rows whose construction failed."""
    df = with_state(df)
    return cemetery(df).withColumn("type", F.lit(kind))
