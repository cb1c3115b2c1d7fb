"""Segments of each channel's packets, on a stream as on a batch.

A packet has a start, a rate and samples. A segment ends where the rate changes, or where a packet
starts more than ``tolerance`` samples (at the rate of the one before) off what the last packet, or
the samples since the segment's start, let expect: each packet sets its own limit, which a session
window with one gap cannot do. On a stream packets wait in the channel's state until the watermark
has passed them, so that late ones take their place in time and repeated ones (equal starts; of
these the lowest rate, then the fewest samples) count once; a timer in event time ends the segment that
no packet can prolong any more. A batch streams through sorted rows and holds the open segment only.

Packets later than the watermark are left out, as Spark does; rates and samples that are not above zero and null
starts take no part; null keys are a channel of their own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

OUT = "starttime double, endtime double, rate double, npts long, npackets long"
STATE = "starts array<double>, rates array<double>, npts array<long>, open array<double>"


def step(open_: list[float], start: float, rate: float, npts: int, tolerance: float) -> tuple[dict | None, list[float]]:
    """The segment that the packet ends, if any, and the open one: start, rate, samples, packets, and
    start and samples of its last packet."""
    if open_:
        began, own, n, packets, last, last_n = open_
        if start == last:
            return None, open_
        off = max(abs((start - last) * own - last_n), abs((start - began) * own - n))
        if rate == own and off <= tolerance:
            return None, [began, own, n + npts, packets + 1, start, npts]
    return closed(open_), [start, rate, npts, 1, start, npts]


def closed(open_: list[float]) -> dict | None:
    if not open_:
        return None
    began, rate, n, packets, *_ = open_
    return {"starttime": began, "endtime": began + (n - 1) / rate, "rate": rate, "npts": int(n), "npackets": int(packets)}


def channel_segments(df: DataFrame, keys: Sequence[str], time: str = "ts", rate: str = "rate", npts: str = "npts", tolerance: float = 0.5, late: str = "10 minutes") -> DataFrame:
    """keys, starttime, endtime (seconds), rate, npts, npackets of each segment."""
    seconds = F.unix_micros(F.col(time).cast("timestamp")) / 1e6
    rows = df.withWatermark(time, late) if df.isStreaming else df
    rows = rows.select(*keys, time, seconds.alias("qf_s"), F.col(rate).cast("double").alias("qf_r"), F.col(npts).cast("long").alias("qf_n")).filter("qf_s IS NOT NULL AND qf_r > 0 AND qf_n > 0")
    kind = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", " + OUT
    names = [*keys, "starttime", "endtime", "rate", "npts", "npackets"]

    def frame(found: list[dict]) -> pd.DataFrame:
        return pd.DataFrame(found, columns=names)

    def sorted_run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, open_ = None, []
        for b in batches:
            found = []
            for *k, s, r, n in b.itertuples(index=False, name=None):
                if k != key and not all(x == y or (pd.isna(x) and pd.isna(y)) for x, y in zip(k, key or [object()] * len(k), strict=True)):
                    if done := closed(open_):
                        found.append(dict(zip(keys, key, strict=True)) | done)
                    key, open_ = k, []
                done, open_ = step(open_, s, r, n, tolerance)
                if done:
                    found.append(dict(zip(keys, key, strict=True)) | done)
            yield frame(found)
        if done := closed(open_):
            yield frame([dict(zip(keys, key, strict=True)) | done])

    def stateful(key, batches, state) -> Iterator[pd.DataFrame]:
        starts, rates, counts, open_ = map(list, state.get) if state.exists else ([], [], [], [])
        waiting = list(zip(starts, rates, counts, strict=True))
        if not state.hasTimedOut:
            for b in batches:
                waiting += list(b[["qf_s", "qf_r", "qf_n"]].itertuples(index=False, name=None))
        mark = state.getCurrentWatermarkMs() / 1000
        waiting.sort()
        found, left = [], []
        for s, r, n in waiting:
            if s >= mark:
                left.append((s, r, n))
                continue
            done, open_ = step(open_, s, r, n, tolerance)
            if done:
                found.append(done)
        if open_ and not (left and expects(open_, left[0], tolerance)) and mark > expiry(open_, tolerance):
            found.append(closed(open_))
            open_ = []
        if left or open_:
            state.update((*([list(c) for c in zip(*left, strict=True)] or [[], [], []]), list(map(float, open_))))
            next_ = min([*([left[0][0]] if left else []), *([expiry(open_, tolerance)] if open_ else [])])
            state.setTimeoutTimestamp(max(int(mark * 1000) + 1, int(next_ * 1000) + 2))
        else:
            state.remove()
        yield frame([dict(zip(keys, key, strict=True)) | f for f in found])

    if df.isStreaming:
        return rows.groupBy(*keys).applyInPandasWithState(stateful, kind, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    slim = rows.select(*keys, "qf_s", "qf_r", "qf_n")
    return slim.repartition(*keys).sortWithinPartitions(*keys, "qf_s", "qf_r", "qf_n").mapInPandas(sorted_run, kind)


def expiry(open_: list[float], tolerance: float) -> float:
    """The last start of a packet that could prolong the segment."""
    return open_[4] + (open_[5] + tolerance) / open_[1]


def expects(open_: list[float], packet: tuple[float, float, int], tolerance: float) -> bool:
    return step(open_, *packet, tolerance)[0] is None
