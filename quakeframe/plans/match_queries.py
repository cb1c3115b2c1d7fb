"""Matchers over the driver's tables."""

from pyspark.sql import functions as F

from quakeframe.operators import group, window
from quakeframe.operators import match as m
from quakeframe.operators.asof import as_of
from quakeframe.plans.registry import PACKETS, packets, query
from quakeframe.sources.hypocentres import TravelTimes, load_hypocenters
from quakeframe.state import ELOG, LIVE


def epochs(t):
    """Gap-separated epochs of each station: no packet for six hours ends one."""
    return window.segment_index(packets(t), ["sta"], gap=21600.0, order=["event_id"])


EPOCHS = """g AS (SELECT *, CASE WHEN time - lag(time) OVER (PARTITION BY sta ORDER BY time, event_id) > 21600 THEN 1 ELSE 0 END AS tear FROM p),
h AS (SELECT *, sum(tear) OVER (PARTITION BY sta ORDER BY time, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM g),
e AS (SELECT sta, segment, min(time) AS starttime, max(time) AS endtime, count(*) AS npackets FROM h GROUP BY sta, segment)"""


@query("match_id", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, o_custkey AS order_custkey, o_orderstatus AS order_status FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(t):
    orders = t("orders").select(F.col("o_orderkey").alias("_id"), F.col("o_custkey").alias("custkey"), F.col("o_orderstatus").alias("status"))
    found = m.ObjectIdMatcher(orders, "order", ["custkey", "status"], id_key="l_orderkey").find(t("lineitem"))
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "order_custkey", "order_status")


@query("match_equality", "SELECT s_suppkey, n_name AS nation_n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def _(t):
    return m.EqualityMatcher(t("nation"), "nation", {"s_nationkey": "n_nationkey"}, ["n_name"], ["n_nationkey"], broadcast=True).find_one(t("supplier"), ["s_suppkey"]).select("s_suppkey", "nation_n_name")


@query(
    "match_equality_multi",
    """WITH b AS (SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY user_id, event_type)
    SELECT event_id, b.first_id AS base_first_id FROM events JOIN b USING (user_id, event_type)""",
)
def _(t):
    base = t("events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_id"))
    return m.EqualityMatcher(base, "base", {"user_id": "user_id", "event_type": "event_type"}, ["first_id"], ["first_id"]).find(t("events")).select("event_id", "base_first_id")


@query("match_seed_start", f"WITH {PACKETS}, {EPOCHS} SELECT event_id, e.segment AS site_segment, e.npackets AS site_npackets FROM p JOIN e ON p.sta = e.sta AND p.time BETWEEN e.starttime AND e.endtime")
def _(t):
    own = m.MiniseedMatcher(epochs(t), "site", ["sta"], ["segment", "npackets"], time="time")
    return own.find_one(packets(t), ["event_id"]).select("event_id", "site_segment", "site_npackets")


@query(
    "match_seed_span",
    f"WITH {PACKETS}, {EPOCHS} SELECT event_id, e.segment AS site_segment, e.sta IS NOT NULL AS live FROM p LEFT JOIN e ON p.sta = e.sta AND p.time >= e.starttime AND p.time + 3600 <= e.endtime",
)
def _(t):
    rows = packets(t).withColumn("endtime", F.col("time") + 3600)
    own = m.MiniseedDBMatcher(epochs(t), "site", ["sta"], ["segment"], time="time")
    return own.normalize(rows, ["event_id"]).select("event_id", "site_segment", LIVE)


_band = f"WITH {PACKETS}, x AS (SELECT * FROM p WHERE chan = 'error'), y AS (SELECT * FROM p WHERE chan = 'purchase')"


def origins(t):
    return packets(t).filter("chan = 'purchase'").select(F.col("event_id").alias("_id"), "time", F.col("value").alias("magnitude"))


@query("match_origin_band", _band + " SELECT x.event_id, y.event_id AS source_id FROM x JOIN y ON abs(y.time - (x.time - 60)) <= 1800")
def _(t):
    own = m.OriginTimeMatcher(origins(t), "source", ["_id"], ["_id"], 1800.0, 60.0, time="time")
    return own.find(packets(t).filter("chan = 'error'")).select("event_id", "source_id")


@query(
    "match_origin_nearest",
    _band
    + """, r AS (SELECT x.event_id, y.event_id AS sid, y.value AS magnitude, row_number() OVER (PARTITION BY x.event_id ORDER BY abs(y.time - (x.time - 60)), y.event_id) AS n, count(*) OVER (PARTITION BY x.event_id) AS hits
    FROM x JOIN y ON abs(y.time - (x.time - 60)) <= 1800)
    SELECT x.event_id, r.sid AS source_id, r.magnitude AS source_magnitude, coalesce(r.hits, 0) AS n_matches FROM x LEFT JOIN r ON x.event_id = r.event_id AND n = 1""",
)
def _(t):
    own = m.OriginTimeMatcher(origins(t), "source", ["_id", "magnitude"], ["_id"], 1800.0, 60.0, time="time")
    out = own.find_one(packets(t).filter("chan = 'error'"), ["event_id"])
    return out.select("event_id", "source_id", "source_magnitude", F.coalesce("n_matches", F.lit(0)).alias("n_matches"))


@query(
    "match_arrival",
    f"""WITH {PACKETS}, {EPOCHS}, a AS (SELECT sta, time, event_id FROM p WHERE chan = 'error'),
    r AS (SELECT e.sta, e.segment, a.event_id, row_number() OVER (PARTITION BY e.sta, e.segment ORDER BY a.time, a.event_id) AS n, count(*) OVER (PARTITION BY e.sta, e.segment) AS hits
    FROM e JOIN a ON e.sta = a.sta AND a.time BETWEEN e.starttime AND e.endtime)
    SELECT e.sta, e.segment, r.event_id AS arrival_event_id, coalesce(hits, 0) AS n_matches, r.sta IS NOT NULL AS live FROM e LEFT JOIN r ON e.sta = r.sta AND e.segment = r.segment AND n = 1""",
)
def _(t):
    arrivals = packets(t).filter("chan = 'error'").select("sta", "time", "event_id")
    own = m.ArrivalMatcher(arrivals, "arrival", ["sta"], ["event_id"], order=["time", "event_id"])
    return own.normalize(epochs(t), ["sta", "segment"]).select("sta", "segment", "arrival_event_id", "n_matches", LIVE)


@query(
    "match_overlapping_epochs",
    """WITH w AS (SELECT nullif(event_type, 'view') AS chan, user_id % 3 AS sta, floor(epoch_us(ts) / 36e8) * 3600 AS t FROM events),
    e AS (SELECT user_id % 4 AS sta, event_id, epoch_us(ts) / 1e6 AS a, CASE WHEN event_id % 50 = 0 THEN 1e13 ELSE epoch_us(ts) / 1e6 + (event_id % 11) * (event_id % 11) * 2000 - 900 END AS z FROM events WHERE event_type = 'error'),
    h AS (SELECT w.sta, w.t, count(*) AS n, min_by(e.event_id, (e.a, e.event_id)) AS first FROM (SELECT DISTINCT sta, t FROM w) w JOIN e ON e.sta = w.sta AND w.t BETWEEN e.a AND e.z GROUP BY ALL)
    SELECT chan, w.sta, w.t AS time, first AS site_event_id, coalesce(n, 0)::BIGINT AS n_matches FROM w LEFT JOIN h ON h.sta = w.sta AND h.t = w.t""",
)
def _(t):
    """Rows that repeat (some with a null key), and epochs of all lengths that overlap, some without
    end and some that end before they start."""
    ids = t("events").select("event_id", "user_id")
    p = packets(t).join(ids, "event_id")
    ends = F.expr("CASE WHEN event_id % 50 = 0 THEN 1e13D ELSE time + (event_id % 11) * (event_id % 11) * 2000 - 900 END AS endtime")
    site = p.filter("chan = 'error'").select((F.col("user_id") % 4).alias("sta"), "event_id", F.col("time").alias("starttime"), ends)
    rows = p.select(F.expr("nullif(chan, 'view') AS chan"), (F.col("user_id") % 3).alias("sta"), (F.floor(F.col("time") / 3600) * 3600).cast("double").alias("time"))
    out = m.MiniseedMatcher(site, "site", ["sta"], ["event_id"], ["starttime", "event_id"], time="time").find_one(rows)
    return out.select("chan", "sta", "time", "site_event_id", "n_matches")


@query(
    "match_kill_on_failure",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, o_orderkey IS NOT NULL AS live, CASE WHEN o_orderkey IS NULL THEN 'no match' END AS message FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON l_orderkey = o_orderkey",
)
def _(t):
    orders = t("orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("_id"), F.col("o_custkey").alias("custkey"))
    out = m.ObjectIdMatcher(orders, "order", ["custkey"], id_key="l_orderkey").normalize(t("lineitem"), ["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", LIVE, F.get(ELOG, F.lit(0))["message"].alias("message"))


@query(
    "match_unique_only",
    """WITH s AS (SELECT user_id, min(event_id) AS k, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY user_id)
    SELECT u.user_id, CASE WHEN s.n = 1 THEN s.k END AS err_event_id, coalesce(s.n, 0) AS n_matches FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN s USING (user_id)""",
)
def _(t):
    errors = t("events").filter("event_type = 'error'").select("user_id", "event_id")
    own = m.EqualityMatcher(errors, "err", {"user_id": "user_id"}, ["event_id"], ["event_id"])
    out = own.find_one(t("events").select("user_id").distinct(), ["user_id"], require_unique=True)
    return out.select("user_id", "err_event_id", F.coalesce("n_matches", F.lit(0)).alias("n_matches"))


@query(
    "match_counts",
    f"""WITH {PACKETS}, {EPOCHS}, b AS (SELECT DISTINCT sta FROM p WHERE value > 150)
    SELECT count(*) AS n, count(e.sta) AS hits_0, count(b.sta) AS hits_1 FROM p LEFT JOIN e ON p.sta = e.sta AND p.time BETWEEN e.starttime AND e.endtime AND e.npackets > 2 LEFT JOIN b ON p.sta = b.sta""",
)
def _(t):
    rows = packets(t)
    first = m.MiniseedMatcher(epochs(t).filter("npackets > 2"), "site", ["sta"], ["segment"], time="time")
    second = m.EqualityMatcher(rows.filter("value > 150").select("sta").distinct().withColumn("tag", F.lit(1)), "loud", {"sta": "sta"}, ["tag"], ["sta"])
    return m.bulk_normalize(rows, [first, second], ["event_id"])[1]


@query(
    "normalizer_list",
    """WITH c AS (SELECT c_custkey AS k, c_mktsegment AS seg FROM customer WHERE c_nationkey < 20), s AS (SELECT o_custkey AS k, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_custkey),
    b AS (SELECT c_custkey AS k, c_acctbal AS bal FROM customer WHERE c_acctbal > 0)
    SELECT o_orderkey, seg AS cust_segment, CASE WHEN seg IS NOT NULL THEN s.n END AS stat_n, CASE WHEN seg IS NOT NULL THEN bal END AS rich_balance,
      seg IS NOT NULL AND bal IS NOT NULL AS live, CASE WHEN seg IS NULL OR bal IS NULL THEN 1 ELSE 0 END AS n_log
    FROM orders LEFT JOIN c ON c.k = o_custkey LEFT JOIN s ON s.k = o_custkey LEFT JOIN b ON b.k = o_custkey""",
)
def _(t):
    """Three normalizers on one key, of which the first and the last kill; the rows are joined once."""
    who = t("customer").select(F.col("c_custkey").alias("_id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"), "c_nationkey")
    stats = t("orders").groupBy(F.col("o_custkey").alias("_id")).agg(F.count("*").alias("n"))
    one = lambda table, prefix, c: m.ObjectIdMatcher(table, prefix, [c], id_key="o_custkey")
    own = [one(who.filter("c_nationkey < 20"), "cust", "segment"), one(stats, "stat", "n"), one(who.filter("balance > 0"), "rich", "balance")]
    out = m.normalize_all(t("orders"), m.normalizers(own, {}))
    return out.select("o_orderkey", "cust_segment", "stat_n", "rich_balance", LIVE, F.size(ELOG).alias("n_log"))


_asof = f"""WITH {PACKETS}, s AS (SELECT min(event_id) AS id, time FROM p WHERE chan = 'purchase' GROUP BY time)
    SELECT p.event_id, {{}} AS source_id FROM p"""
for _direction, _pick in (
    ("backward", "(SELECT s.id FROM s WHERE s.time <= p.time ORDER BY s.time DESC LIMIT 1)"),
    ("forward", "(SELECT s.id FROM s WHERE s.time >= p.time ORDER BY s.time LIMIT 1)"),
    ("nearest", "(SELECT s.id FROM s WHERE abs(s.time - p.time) <= 900 ORDER BY abs(s.time - p.time), s.time LIMIT 1)"),
):

    @query(f"as_of_{_direction}", _asof.format(_pick))
    def _as_of(t, direction=_direction):
        p = packets(t)
        out = as_of(p, p.filter("chan = 'purchase'"), "time", "time", ["event_id"], direction=direction, tolerance=900.0 if direction == "nearest" else None, order=["event_id"])
        return out.select("event_id", F.col("asof_event_id").alias("source_id"))


@query(
    "hypocenters_by_time",
    f"""WITH {PACKETS}, m AS (SELECT event_id, sta, time - 900 AS t0, time + 7200 AS z, floor(time / 86400)::BIGINT AS day FROM p WHERE chan IN ('error', 'view')),
    a AS (SELECT sta, time, event_id % 40 AS lat, event_id % 50 AS lon, event_id % 70 AS depth FROM p WHERE chan = 'click'),
    d AS (SELECT *, degrees(2 * asin(sqrt(least(sin(radians(lat) / 2) ** 2 + cos(radians(lat)) * sin(radians(lon) / 2) ** 2, 1.0)))) AS arc FROM a),
    o AS (SELECT *, time - (20 * arc + 2 * depth) AS origin FROM d WHERE arc <= 90),
    s AS (SELECT min(event_id) AS id, time FROM p WHERE chan = 'purchase' GROUP BY time),
    k AS (SELECT DISTINCT sta, time, id, stime FROM (SELECT o.sta, o.time, s.id, s.time AS stime, row_number() OVER (PARTITION BY o.sta, o.time, o.origin ORDER BY abs(s.time - o.origin), s.time) AS n FROM o JOIN s ON abs(s.time - o.origin) <= 400) WHERE n = 1),
    j AS (SELECT m.day, m.sta, m.t0, m.z, k.id, k.stime, k.time, m.t0 + 900 - k.stime AS off FROM (SELECT DISTINCT day, sta, t0, z FROM m) m JOIN k ON k.sta = m.sta AND k.time BETWEEN m.t0 AND m.z),
    b AS (SELECT day, sta, t0, z, id, min(stime) AS stime, arg_min(off, (abs(off), time)) AS off FROM j GROUP BY ALL),
    r AS (SELECT day, id, round(sqrt(avg(off * off)), 9) AS rms FROM b GROUP BY ALL),
    c AS (SELECT day, arg_min(id, (rms, id)) AS id, count(*) AS n FROM r GROUP BY day)
    SELECT m.event_id, b.id AS source_id, b.id IS NOT NULL AS live, CASE WHEN c.n > 1 AND b.id IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN b.id IS NULL THEN 1 ELSE 0 END AS n_log
    FROM m LEFT JOIN (b JOIN c USING (day, id)) ON b.day = m.day AND b.sta = m.sta AND b.t0 = m.t0 AND b.z = m.z""",
)
def _(t):
    """Members of a day as an ensemble, arrivals of invented hypocentres, times linear in distance and depth."""
    p = packets(t)
    members = p.filter("chan IN ('error', 'view')").select("event_id", "sta", (F.col("time") - 900).alias("t0"), (F.col("time") + 7200).alias("endtime"), F.floor(F.col("time") / 86400).alias("day"))
    zero = F.lit(0.0)
    place = {"site_lat": zero, "site_lon": zero, "source_lat": (F.col("event_id") % 40).cast("double"), "source_lon": (F.col("event_id") % 50).cast("double"), "source_depth": (F.col("event_id") % 70).cast("double")}
    arrivals = p.filter("chan = 'click'").withColumns(place)
    sources = p.filter("chan = 'purchase'").select(F.col("event_id").alias("_id"), zero.alias("lat"), zero.alias("lon"), zero.alias("depth"), "time")
    table = TravelTimes(0.0, 10.0, 0.0, 35.0, [[20 * 10 * i + 2 * 35 * j for i in range(10)] for j in range(4)])
    out = load_hypocenters(members, arrivals, sources, table, ["day"], ["sta"], dt=400.0, t0_offset=900.0)
    return out.select("event_id", "source_id", LIVE, F.size(ELOG).alias("n_log"))


@query("erase_normalized", "SELECT event_id, value FROM events")
def _(t):
    joined = t("events").select("event_id", "value", F.lit("a").alias("site_sta"), F.lit(1.0).alias("channel_lat"))
    return m.erase_normalized(joined)


@query("css_join_right", "SELECT c_custkey, o_orderkey, coalesce(c_custkey, o_custkey) AS k FROM (SELECT * FROM customer WHERE c_nationkey < 12) RIGHT JOIN orders ON c_custkey = o_custkey")
def _(t):
    left = t("customer").filter("c_nationkey < 12").select("c_custkey", F.col("c_custkey").alias("custkey"))
    out = m.table_join(left, t("orders").select("o_orderkey", F.col("o_custkey").alias("custkey")), ["custkey"])
    return out.select("c_custkey", "o_orderkey", F.col("custkey").alias("k"))


@query(
    "css_catalog_chain",
    """SELECT r_name, n_name, c_custkey, count(o_orderkey) AS n FROM region RIGHT JOIN nation ON r_regionkey = n_regionkey RIGHT JOIN customer ON n_nationkey = c_nationkey RIGHT JOIN orders ON c_custkey = o_custkey GROUP BY r_name, n_name, c_custkey""",
)
def _(t):
    from quakeframe.sources.text import catalog_chain

    event = t("region").select(F.col("r_regionkey").alias("evid"), "r_name")
    origin = t("nation").select(F.col("n_regionkey").alias("evid"), F.col("n_nationkey").alias("orid"), "n_name")
    assoc = t("customer").select(F.col("c_nationkey").alias("orid"), F.col("c_custkey").alias("arid"), "c_custkey")
    arrival = t("orders").select(F.col("o_custkey").alias("arid"), "o_orderkey")
    return catalog_chain(event, origin, assoc, arrival).groupBy("r_name", "n_name", "c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("evid_update_counts", "SELECT o_custkey AS evid, count(c_custkey) AS hits, count(*) - count(c_custkey) AS misses FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_nationkey < 12) ON o_custkey = c_custkey GROUP BY o_custkey")
def _(t):
    sources = t("customer").filter("c_nationkey < 12").select(F.col("c_custkey").alias("evid"), F.col("c_name").alias("_id"))
    return group.set_source_id(t("orders").select(F.col("o_custkey").alias("evid")), sources)[1]
