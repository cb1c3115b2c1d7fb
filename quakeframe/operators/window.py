"""Cutting, padding and muting of sample arrays; gaps and overlaps of segments.

A series has t0, dt and ``data``; sample i is at t0 + i * dt. Times go to samples by rounding half
away from zero, as ``round`` does in SQL.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakeframe.operators.merging import joined
from quakeframe.state import ELOG, LIVE, attribute, kill_if, log_if, with_state


def sample_number(time: Column, t0: Column, dt: Column) -> Column:
    return F.round((time - t0) / dt).cast("int")


def end_time(t0="t0", dt="dt", data="data") -> Column:
    return attribute(t0) + (F.size(attribute(data)) - 1) * attribute(dt)


def window_data(df: DataFrame, start, end, t0shift=0.0, short: str = "kill", log: bool = True) -> DataFrame:
    """Cut live series to [start, end], both shifted by ``t0shift`` (a number or a column's name).

    Without overlap the row dies. Where the series is shorter than the window, ``short`` decides:
    ``kill``, ``pad`` (zeros to the full window) or ``truncate`` (to what there is).
    """
    if short not in ("kill", "pad", "truncate"):
        raise ValueError(f"unknown handling {short}")
    df = with_state(df)
    shift = attribute(t0shift) if isinstance(t0shift, str) else F.lit(float(t0shift))
    edge = lambda x: (attribute(x) if isinstance(x, str) else F.lit(float(x))) + shift
    first, last = sample_number(edge(start), attribute("t0"), attribute("dt")), sample_number(edge(end), attribute("t0"), attribute("dt"))
    n = F.size(attribute("data"))
    i0, i1 = F.greatest(first, F.lit(0)), F.least(last, n - 1)
    outside = (last < 0) | (first > n - 1) | (last < first)
    shorter = ~outside & ((first < 0) | (last > n - 1))
    cut = F.slice(attribute("data"), i0 + 1, F.greatest(i1 - i0 + 1, F.lit(0)))
    begin = i0
    if short == "pad":
        zeros = lambda k: F.array_repeat(F.lit(0.0), F.greatest(k, F.lit(0)))
        cut, begin = F.concat(zeros(-first), cut, zeros(last - n + 1)), first
    dies = F.coalesce(outside | shorter if short == "kill" else outside, F.lit(True))
    good = attribute(LIVE) & ~dies
    columns = {
        "data": F.when(good, cut).otherwise(attribute("data")),
        "t0": F.when(good, attribute("t0") + begin * attribute("dt")).otherwise(attribute("t0")),
        LIVE: good,
    }
    if log:
        columns[ELOG] = log_if(attribute(LIVE) & dies, "WindowData", "the window is not covered")
    out = df.withColumns(columns)
    return out.withColumn("npts", F.size(attribute("data"))) if "npts" in df.columns else out


def window_autopad(df: DataFrame, start: float, end: float, pad_fraction_cutoff: float = 0.05) -> DataFrame:
    """As ``window_data``, padded where the missing share of the window is below the cutoff, else dead."""
    df = with_state(df)
    first, last = sample_number(F.lit(float(start)), attribute("t0"), attribute("dt")), sample_number(F.lit(float(end)), attribute("t0"), attribute("dt"))
    wanted = last - first + 1
    there = F.least(last, F.size(attribute("data")) - 1) - F.greatest(first, F.lit(0)) + 1
    missing = (wanted - there) / wanted
    refused = attribute(LIVE) & ~(missing < pad_fraction_cutoff)
    marked = df.withColumn(ELOG, log_if(refused, "WindowData_autopad", "too much is missing")).withColumn(LIVE, attribute(LIVE) & ~refused)
    return window_data(marked, start, end, short="pad")


def regularize_members(df: DataFrame, start: float, end: float, pad_fraction_cutoff: float = 0.05) -> DataFrame:
    """Members on a common range; the dead leave."""
    return window_autopad(df, start, end, pad_fraction_cutoff).filter(LIVE)


def top_mute(df: DataFrame, zero_until: float, full_from: float, shape: str = "linear") -> DataFrame:
    """Zero before the first time (relative to t0's scale), a ramp up to the second, 1 from there."""
    if not zero_until < full_from or shape not in ("linear", "cosine"):
        raise ValueError("the ramp needs two times in order, and a known shape")
    df = with_state(df)

    def weight(i):
        t = attribute("t0") + i * attribute("dt")
        x = (t - zero_until) / (full_from - zero_until)
        ramp = x if shape == "linear" else (1 - F.cos(x * np.pi)) / 2
        return F.when(t <= zero_until, 0.0).when(t >= full_from, 1.0).otherwise(ramp)

    return df.withColumn("data", F.when(attribute(LIVE), F.transform(attribute("data"), lambda v, i: v * weight(i))).otherwise(attribute("data")))


def segments(df: DataFrame, keys: Sequence[str], time: str = "time", end: str | None = None, gap: float = 1.0, order: Sequence[str] = ()) -> DataFrame:
    """Gaps and islands: packets in time order, a new segment where one starts more than ``gap`` after
    the end of the one before. With ``segment`` numbers from 0 for each key."""
    own = Window.partitionBy(*keys).orderBy(time, *order)
    before = F.lag(end or time).over(own)
    tear = F.when(F.col(time) - before > gap, 1).otherwise(0)
    return df.withColumn("qf_tear", tear).withColumn("segment", F.sum("qf_tear").over(own.rowsBetween(Window.unboundedPreceding, 0))).drop("qf_tear")


def segment_index(df: DataFrame, keys: Sequence[str], time: str = "time", end: str | None = None, gap: float = 1.0, order: Sequence[str] = (), size: str | None = None, bucket: Column | None = None) -> DataFrame:
    """One row a segment: start, end, packets, and with ``size`` the offset and length in bytes.

    Two steps, so that no task sorts all packets of a key: segments inside each time bucket (a day of
    ``time``; any expression that does not fall as time rises will do), then these few segments of a
    key in order, joined where no gap parts them.
    """
    end = end or time
    df = df.withColumn("qf_b", bucket if bucket is not None else F.floor(F.col(time) / 86400))
    inside = segments(df, [*keys, "qf_b"], time, end, gap, order).withColumnRenamed("segment", "qf_s")
    sizes = [F.sum(size).alias("nbytes")] if size else []
    local = inside.groupBy(*keys, "qf_b", "qf_s").agg(
        F.min(time).alias("starttime"), F.max(end).alias("endtime"), F.max_by(end, F.struct(time, *order)).alias("qf_last"), F.count("*").alias("npackets"), *sizes
    )
    own = Window.partitionBy(*keys).orderBy("qf_b", "qf_s")
    tear = F.when(F.col("starttime") - F.lag("qf_last").over(own) > gap, 1).otherwise(0)
    ahead = {"foff": F.coalesce(F.sum("nbytes").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))} if size else {}
    marked = local.withColumns({"qf_tear": tear, **ahead}).withColumn("segment", F.sum("qf_tear").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    extra = [F.min("foff").alias("foff"), F.sum("nbytes").alias("nbytes")] if size else []
    return marked.groupBy(*keys, "segment").agg(F.min("starttime").alias("starttime"), F.max("endtime").alias("endtime"), F.sum("npackets").alias("npackets"), *extra)


def gaps_and_overlaps(df: DataFrame, keys: Sequence[str], start="starttime", end="endtime", dt="dt", order: Sequence[str] = (), width: float = 86400.0) -> DataFrame:
    """Each segment with the step from the one before, in samples: a gap above 0.5, an overlap below
    -0.5, and whether dt changed by more than 0.1 percent. Segments are sorted in buckets of ``width``; the
    one before the first of a bucket is the last of the bucket before, of which there is one row a bucket."""
    df = df.withColumn("qf_b", F.floor(F.col(start) / width))
    own = Window.partitionBy(*keys, "qf_b").orderBy(start, *order)
    last = F.struct(F.col(end).alias("end"), F.col(dt).alias("dt"))
    ends = df.groupBy(*keys, "qf_b").agg(F.max_by(last, F.struct(start, *order)).alias("qf_l"))
    ends = ends.select(*keys, "qf_b", F.lag("qf_l").over(Window.partitionBy(*keys).orderBy("qf_b")).alias("qf_l"))
    met = joined(df.withColumn("qf_i", F.lag(last).over(own)), ends, [*keys, "qf_b"], "left")
    met = met.withColumn("qf_i", F.coalesce("qf_i", "qf_l"))
    step = (F.col(start) - F.col(dt) - F.col("qf_i.end")) / F.col(dt)
    rate = F.col("qf_i.dt")
    return met.withColumn("step", step).withColumns(
        {"is_gap": F.coalesce(F.col("step") > 0.5, F.lit(False)), "is_overlap": F.coalesce(F.col("step") < -0.5, F.lit(False)), "dt_changed": F.coalesce(F.abs(F.col(dt) - rate) / rate > 0.001, F.lit(False))}
    ).drop("qf_b", "qf_i", "qf_l")


def in_interval(df: DataFrame, start: float, end: float, begin="starttime", finish="endtime") -> DataFrame:
    """Rows that overlap a closed time interval."""
    return df.filter((F.col(begin) <= end) & (F.col(finish) >= start))


def has_gap(gaps: Column, start: Column, end: Column) -> Column:
    """Whether an array of (starttime, endtime) gaps meets a closed interval."""
    return F.exists(gaps, lambda g: (g["starttime"] <= end) & (g["endtime"] >= start))


def zero_gaps(df: DataFrame, gaps: str = "gaps") -> DataFrame:
    """Zeros at samples inside gaps."""
    t = lambda i: F.col("t0") + i * F.col("dt")
    inside = lambda i: F.exists(gaps, lambda g: (t(i) >= g["starttime"]) & (t(i) <= g["endtime"]))
    return df.withColumn("data", F.transform("data", lambda x, i: F.when(inside(i), 0.0).otherwise(x)))


def agc_rms(x: np.ndarray, half: int) -> np.ndarray:
    """Root mean square over a centred window of 2 * half + 1 samples, shorter at the ends; of several
    components (rows) together."""
    x = np.atleast_2d(np.asarray(x, float))
    power = np.r_[0.0, np.cumsum((x**2).sum(0))]
    i = np.arange(x.shape[1])
    low, high = np.maximum(i - half, 0), np.minimum(i + half + 1, x.shape[1])
    return np.sqrt(np.maximum(power[high] - power[low], 0.0) / ((high - low) * len(x)))


def agc_factors(rms: np.ndarray) -> np.ndarray:
    """1 over the root mean square; where that is zero the last factor holds, zero before any."""
    held = np.maximum.accumulate(np.where(rms > 0, np.arange(len(rms)), -1))
    return np.where(held >= 0, 1 / np.where(rms[held] > 0, rms[held], 1.0), 0.0)


def agc(df: DataFrame, seconds: float) -> DataFrame:
    """Automatic gain: samples over the running root mean square, of all components of a row
    together; ``gain`` holds the factors. A window of less than one sample kills.

    The frame is centred from the first sample on and only shorter at the ends; it does not start with
    half a window that leaves out its middle sample, so gains of the first half window differ from
    implementations that do. Only the samples and what the gain needs go through Python."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            new, gain = [], []
            for x, dt, live in zip(b["data"], b["dt"], b[LIVE], strict=True):
                many = len(x) > 0 and np.ndim(x[0]) > 0
                x = np.array([np.asarray(c, float) for c in x]) if many else np.asarray(x, float)
                factor = agc_factors(agc_rms(x, round(seconds / dt) // 2)) if live and x.size else np.ones(x.shape[-1])
                gain.append(factor.tolist())
                new.append((x * factor).tolist())
            yield b.assign(data=new, gain=gain)

    df = kill_if(with_state(df), F.round(F.lit(seconds) / F.col("dt")) < 2, "agc", "the window is shorter than a sample")
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    return df.mapInPandas(run, StructType([*df.schema.fields, StructField("gain", ArrayType(DoubleType()))]))


def window_components(df: DataFrame, start: Column, end: Column) -> DataFrame:
    """Rows of several components (``data``: an array of arrays) cut to the samples of a closed time
    window that they hold whole; others die."""
    first = F.greatest(F.round((start - F.col("t0")) / F.col("dt")), F.lit(0)).cast("int")
    last = F.round((end - F.col("t0")) / F.col("dt")).cast("int")
    n = F.size(F.get("data", F.lit(0)))
    out = kill_if(with_state(df), (start < F.col("t0") - F.col("dt") / 2) | (last >= n) | (last < first), "window_components", "the window leaves the data")
    out = out.withColumns({"qf_a": first, "qf_z": last})  # before t0 changes
    cut = F.transform("data", lambda c: F.filter(c, lambda x, i: (i >= F.col("qf_a")) & (i <= F.col("qf_z"))))
    out = out.withColumn("data", F.when(F.col(LIVE), cut).otherwise(F.col("data")))
    return out.withColumn("t0", F.when(F.col(LIVE), F.col("t0") + F.col("qf_a") * F.col("dt")).otherwise(F.col("t0"))).drop("qf_a", "qf_z")
