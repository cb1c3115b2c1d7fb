"""The columns that every datum carries: whether it is alive, and its log of errors.

A datum is a row. A failed row is marked dead and flows on; only the undertaker splits dead rows
off. An absent attribute is a null. Log records have no process id or time, so plans stay
deterministic.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIVE, ELOG = "live", "elog"
ELOG_TYPE = "array<struct<algorithm:string,badness:string,message:string>>"
#: Severities, from the worst.
BADNESS = ("Fatal", "Invalid", "Suspect", "Complaint", "Debug", "Informational")

_source: ContextVar[Callable[[str], Column]] = ContextVar("attributes", default=F.col)


def attribute(name: str) -> Column:
    """An attribute of the datum: a column, or a member's field inside ``attributes_of``."""
    return _source.get()(name)


@contextmanager
def attributes_of(source: Callable[[str], Column]):
    """Editors that are applied in this context read their attributes from ``source``."""
    token = _source.set(source)
    try:
        yield
    finally:
        _source.reset(token)


def with_state(df: DataFrame) -> DataFrame:
    """``df`` with the two columns, where it lacks them."""
    if LIVE not in df.columns:
        df = df.withColumn(LIVE, F.lit(True))
    if ELOG not in df.columns:
        df = df.withColumn(ELOG, F.array().cast(ELOG_TYPE))
    return df


def log_entry(algorithm: str, message: str | Column, badness: str = "Invalid") -> Column:
    if badness not in BADNESS:
        raise ValueError(f"{badness} is no severity")
    text = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(algorithm).alias("algorithm"), F.lit(badness).alias("badness"), text.alias("message"))


def log_if(condition: Column, algorithm: str, message: str | Column, badness: str = "Invalid") -> Column:
    """The log, with one more record where the condition holds."""
    return F.when(F.coalesce(condition, F.lit(False)), F.array_append(attribute(ELOG), log_entry(algorithm, message, badness))).otherwise(attribute(ELOG))


def kill_if(df: DataFrame, condition: Column, algorithm: str, message: str | Column, badness: str = "Invalid", log: bool = True) -> DataFrame:
    """Mark live rows dead where the condition holds; a null condition does not hold."""
    df = with_state(df)
    hit = attribute(LIVE) & F.coalesce(condition, F.lit(False))
    columns = {LIVE: attribute(LIVE) & ~F.coalesce(condition, F.lit(False))}
    if log:
        columns[ELOG] = log_if(hit, algorithm, message, badness)
    return df.withColumns(columns)


def log_error(df: DataFrame, condition: Column, algorithm: str, message: str | Column, badness: str = "Complaint") -> DataFrame:
    """Log, without a kill, on live rows where the condition holds."""
    df = with_state(df)
    return df.withColumn(ELOG, log_if(attribute(LIVE) & condition, algorithm, message, badness))
