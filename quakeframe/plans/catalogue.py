"""All registered queries, and the flagship."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeframe.operators import edit, match
from quakeframe.plans import array_queries, edit_queries, group_queries, kernel_queries, quality_queries, record_queries, stream_queries  # noqa: F401  they register
from quakeframe.plans.match_queries import EPOCHS, epochs
from quakeframe.plans.registry import ORACLE_SQL, PACKETS, QUERIES, packets, query, rounded


@query(
    "flagship",
    f"""WITH {PACKETS}, {EPOCHS}, j AS (SELECT p.sta, p.value, p.time, e.segment, p.value BETWEEN 5 AND 150 AND e.sta IS NOT NULL AS live
    FROM p LEFT JOIN e ON p.sta = e.sta AND p.time BETWEEN e.starttime AND e.endtime AND e.npackets > 1 AND p.value BETWEEN 5 AND 150)
    SELECT sta, count(*) AS n, count(*) FILTER (live) AS n_live, round(min(time) FILTER (live), 3) AS first_time, round(max(time) FILTER (live), 3) AS last_time,
    round(median(value) FILTER (live), 6) AS median_value, count(DISTINCT segment) FILTER (live) AS n_segments FROM j GROUP BY sta""",
)
def _flagship(t) -> DataFrame:
    """Packets of sane value, matched to their station's epoch, as ensembles with live counts, time
    range and median."""
    checked = edit.FiringSquad([edit.MetadataInterval("value", 5.0, 150.0)]).apply(packets(t))
    site = match.MiniseedMatcher(epochs(t).filter("npackets > 1"), "site", ["sta"], ["segment"], time="time")
    rows = site.normalize(checked, ["event_id"])
    live = lambda c: F.when(F.col("live"), F.col(c))
    return rows.groupBy("sta").agg(
        F.count("*").alias("n"),
        F.sum(F.col("live").cast("long")).alias("n_live"),
        rounded(F.min(live("time")), 3).alias("first_time"),
        rounded(F.max(live("time")), 3).alias("last_time"),
        rounded(F.median(live("value"))).alias("median_value"),
        F.count_distinct(live("site_segment")).alias("n_segments"),
    )


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flagship"](spark, sf_dir)


__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
