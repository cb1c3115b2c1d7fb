"""Lookups by station codes and time, reports, and the reader of a time interval."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quakeframe.operators.asof import within
from quakeframe.operators.group import fold
from quakeframe.operators.intervals import interval_cells, point_cells
from quakeframe.operators.match import MiniseedMatcher
from quakeframe.operators.merging import merge, shuffled
from quakeframe.operators.window import in_interval
from quakeframe.state import LIVE


def by_codes(df: DataFrame, net=None, sta=None, chan=None, loc=None, time: float | None = None) -> DataFrame:
    """Rows of the given codes whose epoch holds the time strictly inside."""
    for name, value in (("net", net), ("sta", sta), ("chan", chan), ("loc", loc)):
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df.filter((F.col("starttime") < time) & (F.col("endtime") > time)) if time is not None else df


def seed_site(site: DataFrame, net, sta, loc=None, time=None) -> DataFrame:
    """The first site row in the order of start times and ids; with ``n_matches``."""
    return _first(by_codes(site, net, sta, None, loc, time))


def seed_channel(channel: DataFrame, net, sta, chan, loc=None, time=None) -> DataFrame:
    """The channel row; among several without a location code asked for, one with none comes first,
    then one with an empty one."""
    rows = by_codes(channel, net, sta, chan, loc, time)
    return _first(rows, [F.when(F.col("loc").isNull(), 0).when(F.col("loc") == "", 1).otherwise(2)])


def response(channel: DataFrame, net, sta, chan, time, loc=None, column: str = "response") -> DataFrame:
    """The response of the channel at a time: of several rows the first, with ``n_matches``; no row if
    there is none. All codes but loc and the time are needed."""
    if None in (net, sta, chan, time):
        raise ValueError("net, sta, chan and time are needed")
    return _first(by_codes(channel, net, sta, chan, loc, time)).select(column, "n_matches")


def _first(rows: DataFrame, before: Sequence = ()) -> DataFrame:
    n = rows.agg(F.count("*").alias("n_matches"))
    return rows.orderBy(*before, "starttime", "_id").limit(1).crossJoin(F.broadcast(n))


def report(df: DataFrame, net=None, sta=None, chan=None, loc=None, time=None) -> DataFrame:
    """Rows for display, with times as text (UTC, whatever the session's time zone)."""
    rows = by_codes(df, net, sta, chan, loc, time)
    codes = [c for c in ("net", "sta", "chan", "loc", "lat", "lon", "elev", "hang", "vang") if c in df.columns]
    text = lambda c: F.expr(f"CAST(TIMESTAMP_NTZ '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, CAST({c} AS DECIMAL(18, 6))) AS STRING)")
    return rows.select(*codes, text("starttime").alias("from"), text("endtime").alias("to")).orderBy(*codes)


def read_time_interval(df: DataFrame, start: float, end: float, fix_overlaps: bool = False, zero_gaps: bool = False, keep_dead: bool = False) -> DataFrame:
    """Ensembles (by chan and loc) of the series that meet a closed interval: the segments of each
    net, sta, chan and loc merged and cut to it, the dead dropped unless kept."""
    keys = ["chan", "loc", "net", "sta"]
    rows = df.withColumn("loc", F.coalesce("loc", F.lit(""))).withColumns({"starttime": F.col("t0"), "endtime": F.col("t0") + (F.size("data") - 1) * F.col("dt")})
    merged = merge(in_interval(rows, start, end), keys, fix_overlaps, zero_gaps, start, end)
    merged = merged if keep_dead else merged.filter(LIVE)
    return fold(merged, ["chan", "loc"], ["net", "sta"])


def apply_calib(df: DataFrame, calibs: DataFrame, key: str = "channel_id", kill_if_undefined: bool = True) -> DataFrame:
    """Samples times the calibration of the row's channel; the row's own ``calib`` becomes 1 if it has
    one. A channel without calibration kills, or leaves the samples with a Complaint."""
    from quakeframe.state import log_if, with_state

    known = calibs.select(F.col("_id").alias("qf_k"), F.col("calib").alias("qf_c")).dropDuplicates(["qf_k"])
    joined = with_state(df).join(known, F.col(key) == F.col("qf_k"), "left")
    none = F.col(LIVE) & F.col("qf_c").isNull()
    out = joined.withColumn("data", F.when(F.col(LIVE) & F.col("qf_c").isNotNull(), F.transform("data", lambda x: x * F.col("qf_c"))).otherwise(F.col("data")))
    if "calib" in df.columns:
        out = out.withColumn("calib", F.when(F.col(LIVE) & F.col("qf_c").isNotNull() & F.col("calib").isNotNull(), 1.0).otherwise(F.col("calib")))
    out = out.withColumn("elog", log_if(none, "apply_calib", "no calibration", "Invalid" if kill_if_undefined else "Complaint"))
    if kill_if_undefined:
        out = out.withColumn(LIVE, F.col(LIVE) & F.col("qf_c").isNotNull())
    return out.drop("qf_k", "qf_c")


def link_sources(df: DataFrame, sources: DataFrame, dt: float = 10.0, time: str = "starttime", prefer_evid: bool = False) -> DataFrame:
    """``source_id`` of the source within ``dt`` seconds (closed) of the row's time: the only one; of
    several the last by time and id. With ``prefer_evid`` the first with an evid comes before, and
    ``evid`` is copied where the row's source has one. Every row stays, whatever repeats: the first and
    last hits of the distinct times are neighbours of the ends of the band, so that no pairs are made."""
    evid = F.col("evid") if "evid" in sources.columns else F.lit(None)
    slim = sources.select(F.col("_id").alias("id"), F.col("time").cast("double").alias("qf_t"), evid.alias("evid"))
    wanted = df.select(F.col(time).alias("qf_w")).dropna().distinct()

    def one(rows: DataFrame, pick, at: str) -> DataFrame:
        value = F.struct(F.col("qf_t").alias("t"), pick(F.struct("id", "evid"), F.struct("id")).alias("s"))
        folded = rows.groupBy("qf_t").agg(value.alias("qf_v"), F.count("*").alias("qf_m"))
        return within(wanted, folded, dt).select(F.col("qf_w").alias(f"qf_{at}"), F.col(at)["s"].alias(f"qf_s_{at}"))

    found = one(slim, F.max_by, "last").withColumnsRenamed({"qf_last": "qf_at", "qf_s_last": "qf_s"})
    if prefer_evid:  # those with an evid are among the hits, too
        known = one(slim.filter("evid IS NOT NULL"), F.min_by, "first")
        found = found.join(shuffled(known), F.col("qf_at") == F.col("qf_first"), "left").select("qf_at", F.coalesce("qf_s_first", "qf_s").alias("qf_s"))
    columns = {"source_id": F.col("qf_s.id")}
    if prefer_evid:
        columns["evid"] = F.coalesce(F.col("qf_s.evid"), F.col("evid")) if "evid" in df.columns else F.col("qf_s.evid")
    return df.join(shuffled(found), F.col(time) == F.col("qf_at"), "left").withColumns(columns).drop("qf_at", "qf_s")


def network_from_sites(df: DataFrame, site: DataFrame, time: str = "time", ignore: Sequence[str] = (), closed: bool = False) -> DataFrame:
    """``net`` from the one site epoch (open, or closed, interval) of the row's station, where the row has
    none; ``n_sites`` tells ambiguous (above 1) and missing (0) stations. Distinct stations and times
    meet the epochs in cells of time, and the result is joined back, so that rows are neither
    multiplied nor carry epochs."""
    epochs = site.select(F.col("sta").alias("qf_s"), "net", "starttime", "endtime").filter("net IS NOT NULL").distinct()
    cells = epochs.withColumn("qf_c", F.explode(interval_cells(F.col("starttime"), F.col("endtime")))).withColumnRenamed("net", "qf_net")
    wanted = df.filter(~F.col("sta").isin(*ignore, "")).select(F.col("sta").alias("qf_sta"), F.col(time).alias("qf_t")).distinct()
    at, a, z = F.col("qf_t"), F.col("starttime"), F.col("endtime")
    inside = (at >= a) & (at <= z) if closed else (at > a) & (at < z)
    met = wanted.withColumn("qf_p", F.explode(point_cells(at))).join(cells, (F.col("qf_sta") == F.col("qf_s")) & (F.col("qf_p") == F.col("qf_c")) & inside)
    found = met.groupBy("qf_sta", "qf_t").agg(F.count("*").alias("qf_n"), F.min("qf_net").alias("qf_net"))
    joined = df.join(found, (F.col("sta") == F.col("qf_sta")) & (F.col(time) == F.col("qf_t")), "left")
    once = F.when(F.col("qf_n") == 1, F.col("qf_net"))
    return joined.withColumns({"n_sites": F.coalesce("qf_n", F.lit(0)).cast("long"), "net": F.coalesce("net", once)}).drop("qf_sta", "qf_t", "qf_n", "qf_net")


def arrival_networks(arrivals: DataFrame, site: DataFrame, sta: str | None = None, allowed_overlap: float = 86401.0, time: str = "time") -> DataFrame:
    """``net`` of arrivals from the site epoch (closed) that holds their time: of several the one that
    starts last. Raises if epochs of a station overlap by more than is allowed. With ``sta`` only that
    station's arrivals change."""
    own = site if sta is None else site.filter(F.col("sta") == sta)
    if not overlapping_epochs(own, allowed_overlap).isEmpty():
        raise ValueError("site epochs of a station overlap")
    epochs = own.select("sta", "net", "starttime", "endtime").dropna().distinct()
    found = MiniseedMatcher(epochs.withColumn("qf_last", -F.col("starttime")), "qf", ["sta"], ["net"], ["qf_last", "net"], time=time).find_one(arrivals)
    net = F.coalesce("qf_net", "net") if "net" in arrivals.columns else F.col("qf_net")
    return found.withColumn("net", net).select(*dict.fromkeys([*arrivals.columns, "net"]))


def overlapping_epochs(site: DataFrame, allowed: float = 0.0) -> DataFrame:
    """Site epochs of a station that start before the one before ends, by more than is allowed."""
    own = Window.partitionBy("sta").orderBy("starttime", "endtime")
    return site.withColumn("overlap", F.lag("endtime").over(own) - F.col("starttime")).filter(F.col("overlap") > allowed)
