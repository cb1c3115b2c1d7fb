"""Dense ensembles: members on one grid as an array of arrays, with the members' headers beside."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeframe.functions.signal import interpolated
from quakeframe.operators.group import fold
from quakeframe.sources.tables import condition
from quakeframe.state import LIVE, kill_if, with_state


def gather(df: DataFrame, keys: Sequence[str], order: Sequence[str], data: str = "data") -> DataFrame:
    """One row an ensemble: ``matrix`` (member by sample), ``headers``, npts, t0, dt; ``regular`` is
    whether all live members share the grid."""
    live = with_state(df).filter(LIVE)
    out = fold(live, keys, order)
    same = live.groupBy(*keys).agg(
        ((F.min("t0") == F.max("t0")) & (F.min("dt") == F.max("dt")) & (F.min(F.size(data)) == F.max(F.size(data)))).alias("regular"),
        F.min("t0").alias("t0"), F.min("dt").alias("dt"), F.min(F.size(data)).alias("npts"), F.count("*").alias("size"),
    )
    headers = [c for c in live.columns if c != data]
    shaped = out.select(*keys, F.transform("members", lambda m: m[data]).alias("matrix"), F.transform("members", lambda m: F.struct(*[m[c].alias(c) for c in headers])).alias("headers"))
    return shaped.join(same, list(keys))


def fitting(df: DataFrame, rows: DataFrame, keys: Sequence[str], data: str = "data") -> DataFrame:
    """``rows``; those of no gather of ``df``, or with another number of samples than it, are dead."""
    sizes = df.select(*keys, F.col("npts").alias("qf_npts"))
    bad = F.coalesce(F.size(data) != F.col("qf_npts"), F.lit(True))
    return kill_if(with_state(rows).join(sizes, list(keys), "left"), bad, "append", "no gather of this number of samples").drop("qf_npts")


def append(df: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[str], data: str = "data") -> DataFrame:
    """Gathers with the live fitting ``rows`` (``fitting`` tells which) behind their members, in order.
    The rows have the members' headers; a gather that gets none stays as it is."""
    headers = df.schema["headers"].dataType.elementType.names
    more = gather(fitting(df, rows, keys, data).select(*headers, data), keys, order, data)
    names = {c: f"qf_{c}" for c in ("matrix", "headers", "regular", "t0", "dt", "npts", "size")}
    both = df.join(more.withColumnsRenamed(names), list(keys), "left")
    got = F.col("qf_size").isNotNull()
    grid = F.col("regular") & F.col("qf_regular") & (F.col("t0") == F.col("qf_t0")) & (F.col("dt") == F.col("qf_dt"))
    joined = {c: F.when(got, F.concat(c, f"qf_{c}")).otherwise(F.col(c)) for c in ("matrix", "headers")}
    return both.withColumns(joined | {"regular": F.when(got, grid).otherwise(F.col("regular")), "size": F.col("size") + F.coalesce("qf_size", F.lit(0))}).select(*df.columns)


def save_gathers(df: DataFrame, path: str, mode: str = "append") -> None:
    """Gathers under ``path``, the matrix as the last column."""
    df.select(*[c for c in df.columns if c != "matrix"], "matrix").write.mode(mode).parquet(path)


def read_gathers(spark: SparkSession, path: str, query: dict | None = None) -> DataFrame:
    """Gathers that fit a document filter."""
    df = spark.read.parquet(path)
    return df.filter(condition(query)) if query else df


def member(matrix: str, j: int) -> Column:
    """The j-th member, from 0; null beyond."""
    return F.get(matrix, F.lit(j))


def subset(df: DataFrame, start: int, end: int | None = None) -> DataFrame:
    """Members start to end (exclusive) of each gather."""
    n = F.lit(end) if end is not None else F.size("matrix")
    size = F.greatest(n - start, F.lit(0))
    return df.withColumns({"matrix": F.slice("matrix", start + 1, size), "headers": F.slice("headers", start + 1, size)}).withColumn("size", F.size("matrix").cast("long"))


def regrid(x: np.ndarray, t0: float, dt: float, new_t0: float, new_dt: float, npts: int) -> dict:
    """A record on a common grid: linear between its samples, zero beyond."""
    t = new_t0 + np.arange(npts) * new_dt
    return {"data": np.interp(t, t0 + np.arange(len(x)) * dt, x, left=0.0, right=0.0), "t0": new_t0, "dt": new_dt}


def resampled(x: np.ndarray, t0: float, dt: float, new_dt: float) -> dict:
    return {"data": interpolated(x, t0, dt, 1 / new_dt)[0], "dt": new_dt}
