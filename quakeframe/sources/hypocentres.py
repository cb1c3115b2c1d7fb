"""Sources of ensembles by arrivals: a predicted origin time, and the source nearest to it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakeframe.operators.asof import as_of
from quakeframe.operators.match import ArrivalMatcher
from quakeframe.operators.merging import joined, shuffled
from quakeframe.state import ELOG, LIVE, log_if, with_state


def arc(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Degrees between two places on a sphere."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    h = F.pow(F.sin((b - a) / 2), F.lit(2)) + F.cos(a) * F.cos(b) * F.pow(F.sin(d / 2), F.lit(2))
    return F.degrees(2 * F.asin(F.sqrt(F.least(h, F.lit(1.0)))))


@dataclass
class TravelTimes:
    """Travel times of a phase over evenly spaced distances (degrees) and depths (km)."""

    distance0: float
    distance_step: float
    depth0: float
    depth_step: float
    times: Sequence[Sequence[float]]  # a row for each depth

    def at(self, distance: Column, depth: Column) -> Column:
        """Bilinear interpolation; null outside the table."""
        table = F.array(*[F.array(*[F.lit(float(t)) for t in row]) for row in self.times])
        nx, ny = len(self.times[0]), len(self.times)
        x, y = (distance - self.distance0) / self.distance_step, (depth - self.depth0) / self.depth_step
        i, j = F.least(F.floor(x), F.lit(nx - 2)).cast("int"), F.least(F.floor(y), F.lit(ny - 2)).cast("int")
        u, v = x - i, y - j
        value = lambda a, b: F.get(F.get(table, b), a)
        low = value(i, j) * (1 - u) + value(i + 1, j) * u
        high = value(i, j + 1) * (1 - u) + value(i + 1, j + 1) * u
        return F.when(x.between(0, nx - 1) & y.between(0, ny - 1), low * (1 - v) + high * v)


def load_hypocenters(
    df: DataFrame, arrivals: DataFrame, sources: DataFrame, times: TravelTimes, ensemble: Sequence[str], codes: Sequence[str] = ("net", "sta"), dt: float = 10.0, t0_definition: str = "origin_time", t0_offset: float = 0.0, kill_null: bool = True
) -> DataFrame:
    """Members (t0, endtime, ``codes``) with source_id, source_lat, _lon, _depth, _time and their arrival time.

    ``arrivals`` (codes, time, site_lat, site_lon, source_lat, source_lon, source_depth) that fall into a member
    predict an origin time by the table; the nearest of ``sources`` (_id, lat, lon, depth, time) within ``dt`` seconds
    is the arrival's. Where an ensemble meets several sources, the one with the least root mean square misfit of
    the members' start times is taken (equal ones: the smaller id), with a Complaint: t0 plus the offset against the
    origin time, or against the arrival time (``phase_time``). Of several arrivals of a member from that source the one
    of least misfit counts. Members without one die, unless ``kill_null`` is off; dead members stay as they are.
    """
    if t0_definition not in ("origin_time", "phase_time"):
        raise ValueError(f"unknown definition of t0: {t0_definition}")
    df = with_state(df)
    distance = arc(F.col("source_lat"), F.col("source_lon"), F.col("site_lat"), F.col("site_lon"))
    timed = arrivals.withColumn("qf_origin", F.col("time") - times.at(distance, F.col("source_depth")))
    known = as_of(timed.select(*codes, "time", "qf_origin"), sources, "qf_origin", "time", ["_id", "lat", "lon", "depth", "time"], tolerance=dt, order=["_id"]).filter("asof__id IS NOT NULL")
    known = known.select(*codes, F.col("time").alias("qf_arrival"), *[F.col(f"asof_{c}").alias(c) for c in ("_id", "lat", "lon", "depth")], F.col("asof_time").alias("otime")).distinct()
    own = list(dict.fromkeys([*ensemble, *codes, "t0", "endtime"]))
    slim = df.filter(LIVE).select(*own).distinct()  # no samples
    pairs = ArrivalMatcher(known, "qf", codes, ["_id", "lat", "lon", "depth", "otime", "qf_arrival"], ["qf_arrival", "_id"], start="t0", end="endtime", table_time="qf_arrival").find(slim)
    pairs = pairs.withColumnRenamed("qf_qf_arrival", "qf_arrival")
    reference = F.col("qf_otime") if t0_definition == "origin_time" else F.col("qf_arrival")
    pairs = pairs.withColumn("qf_off", F.col("t0") - (reference - t0_offset))
    best = pairs.groupBy(*own, "qf_id").agg(F.min_by(F.struct("qf_lat", "qf_lon", "qf_depth", "qf_otime", "qf_arrival", "qf_off"), F.struct(F.abs("qf_off"), "qf_arrival")).alias("x"))
    rated = best.groupBy(*ensemble, "qf_id").agg(F.sqrt(F.avg(F.col("x.qf_off") * F.col("x.qf_off"))).alias("rms"))
    chosen = rated.groupBy(*ensemble).agg(F.min_by("qf_id", F.struct(F.round("rms", 9), "qf_id")).alias("qf_source"), F.count("*").alias("qf_sources"))
    picked = joined(shuffled(best), chosen, ensemble, "inner").filter("qf_id = qf_source").select(*own, "qf_id", "x.*", "qf_sources")
    out = joined(df, shuffled(picked), own, "left")
    named = {"source_id": "qf_id", "source_lat": "qf_lat", "source_lon": "qf_lon", "source_depth": "qf_depth", "source_time": "qf_otime", "arrival_time": "qf_arrival"}
    out = out.withColumns({k: F.when(F.col(LIVE), F.col(c)) for k, c in named.items()}).withColumn("qf_sources", F.when(F.col(LIVE), F.col("qf_sources")))
    none = F.col(LIVE) & F.col("source_id").isNull()
    out = out.withColumn(ELOG, log_if(F.col("qf_sources") > 1, "load_hypocenters", "several sources, the best was taken", "Complaint"))
    out = out.withColumn(ELOG, log_if(none, "load_hypocenters", "no arrival of a known source", "Invalid" if kill_null else "Complaint"))
    out = out.withColumn(LIVE, F.col(LIVE) & ~none) if kill_null else out
    return out.drop("qf_id", "qf_lat", "qf_lon", "qf_depth", "qf_otime", "qf_arrival", "qf_off", "qf_sources")
