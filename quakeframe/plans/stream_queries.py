"""Batch forms of the streaming operators over the events; the streams are tested to agree."""

from quakeframe.plans.registry import query
from quakeframe.streaming import windows


@query("time_chunks", "SELECT event_type, epoch(time_bucket(INTERVAL 1 day, ts))::BIGINT AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type, time_bucket(INTERVAL 1 day, ts)")
def _(t):
    from pyspark.sql import functions as F

    out = windows.chunked(t("events"), "ts", ["event_type"], "1 day")
    start = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', start)")
    return out.select("event_type", start.alias("start"), "n", F.round("total", 4).alias("total"))


@query(
    "session_segments",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 hour THEN 0 ELSE 1 END AS tear FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(tear) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
)
def _(t):
    from pyspark.sql import functions as F

    out = windows.packet_segments(t("events"), "ts", ["user_id"], "6 hours")
    return out.select("user_id", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', start)").alias("start"), "n")


@query("without_repeats", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type")
def _(t):
    twice = t("events").unionByName(t("events"))
    return windows.without_repeats(twice, "ts", ["event_id", "ts"]).groupBy("user_id", "event_type").count().withColumnRenamed("count", "n")


@query(
    "channel_segments",
    """WITH RECURSIVE d AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, max(CASE WHEN event_type IN ('click', 'view') THEN 86400.0 ELSE 43200.0 END)::DOUBLE AS step FROM events GROUP BY ALL),
    f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) AS k FROM d),
    r AS (SELECT user_id, k, t, step, t AS began, 1::BIGINT AS n, 0::BIGINT AS segment FROM f WHERE k = 1
      UNION ALL SELECT f.user_id, f.k, f.t, f.step, CASE WHEN x.tear THEN f.t ELSE r.began END, CASE WHEN x.tear THEN 1 ELSE r.n + 1 END, r.segment + CASE WHEN x.tear THEN 1 ELSE 0 END
      FROM r JOIN f ON f.user_id = r.user_id AND f.k = r.k + 1,
      LATERAL (SELECT f.step <> r.step OR abs((f.t - r.t) / r.step - 1) > 0.5 OR abs((f.t - r.began) / r.step - r.n) > 0.5 AS tear) x)
    SELECT user_id, round(min(t), 3) AS starttime, round(min(t) + (count(*) - 1) * min(step), 3) AS endtime, count(*) AS npackets FROM r GROUP BY user_id, segment""",
)
def _(t):
    """Packets of one sample that lasts a day, or half a day for some types; all twice."""
    from pyspark.sql import functions as F

    from quakeframe.streaming.segments import channel_segments

    rate = F.when(F.col("event_type").isin("click", "view"), 1 / 86400.0).otherwise(1 / 43200.0)
    rows = t("events").select("user_id", "ts", rate.alias("rate"), F.lit(1).alias("npts"))
    out = channel_segments(rows.unionByName(rows), ["user_id"])
    return out.select("user_id", F.round("starttime", 3).alias("starttime"), F.round("endtime", 3).alias("endtime"), "npackets")
