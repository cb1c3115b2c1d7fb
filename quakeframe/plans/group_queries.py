"""Ensembles over the driver's tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quakeframe.functions import gather
from quakeframe.history import alg_id, algorithms, ancestors, edges, origins, renamed, usage
from quakeframe.operators import edit, group, window
from quakeframe.plans.match_queries import EPOCHS, epochs
from quakeframe.plans.registry import PACKETS, SERIES, packets, query, rounded, series


@query("fold_by_key", f"WITH {PACKETS} SELECT sta, count(*) AS n, list(event_id ORDER BY time, event_id)::VARCHAR AS ids FROM p GROUP BY sta")
def _(t):
    out = group.fold(packets(t).select("sta", "time", "event_id"), ["sta"], ["time", "event_id"])
    ids = F.concat(F.lit("["), F.array_join(F.transform("members", lambda x: x["event_id"].cast("string")), ", "), F.lit("]"))
    return out.select("sta", F.size("members").cast("long").alias("n"), ids.alias("ids"))


@query("ensemble_size", f"WITH {PACKETS} SELECT sta, count(*) AS n_members, count(*) FILTER (value <= 100) AS n_live, bool_or(value <= 100) AS has_live FROM p GROUP BY sta")
def _(t):
    return group.number_live(edit.MetadataGT("value", 100).apply(packets(t)), ["sta"])


for _metric, _low, _high in (("inner", "max(starttime)", "min(endtime)"), ("outer", "min(starttime)", "max(endtime)"), ("median", "median(starttime)", "median(endtime)"), ("mean", "avg(starttime)", "avg(endtime)")):

    @query(f"ensemble_time_range_{_metric}", f"WITH {PACKETS}, {EPOCHS} SELECT sta, round({_low}, 3) AS range_start, round({_high}, 3) AS range_end FROM e GROUP BY sta")
    def _range(t, metric=_metric):
        out = group.ensemble_time_range(epochs(t), ["sta"], metric)
        return out.select("sta", rounded("range_start", 3).alias("range_start"), rounded("range_end", 3).alias("range_end"))


@query(
    "sort_ensemble_null",
    f"""WITH {PACKETS}, q AS (SELECT *, nullif(chan, 'click') AS kind FROM p WHERE value <= 100)
    SELECT event_id, row_number() OVER (PARTITION BY sta ORDER BY coalesce(kind, 'zzz') DESC, event_id) AS ordinal FROM q""",
)
def _(t):
    df = edit.MetadataGT("value", 100).apply(packets(t)).withColumn("kind", F.expr("nullif(chan, 'click')"))
    return group.sort_ensemble(df, ["sta"], "kind", "zzz", ascending=False, tie=["event_id"]).select("event_id", F.col("ordinal").cast("long").alias("ordinal"))


for _center, _sql in (("median", "median(r)"), ("mean", "avg(r)")):

    @query(
        f"demean_residuals_{_center}",
        f"""WITH l AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice AS a, l_quantity * 1000.0 AS b, l_extendedprice - l_quantity * 1000.0 AS r FROM lineitem),
        c AS (SELECT l_suppkey, {_sql} AS c, count(*) AS n FROM l GROUP BY l_suppkey)
        SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CASE WHEN n > 1 THEN round(r - c, 4) END AS residual, CASE WHEN n > 1 THEN round(a - c, 4) END AS corrected_time FROM l JOIN c USING (l_suppkey)""",
    )
    def _demean(t, center=_center):
        df = t("lineitem").withColumns({"a": F.col("l_extendedprice"), "b": F.col("l_quantity") * 1000.0})
        out = group.demean_residuals(df, ["l_suppkey"], "a", "b", center)
        return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", rounded("residual", 4).alias("residual"), rounded("corrected_time", 4).alias("corrected_time"))


_nets = "WITH q AS (SELECT c_mktsegment AS sta, c_nationkey % 3 AS net FROM customer WHERE c_mktsegment <> 'BUILDING' OR c_nationkey % 3 = 1) "


def networks(t):
    return t("customer").select(F.col("c_mktsegment").alias("sta"), (F.col("c_nationkey") % 3).alias("net")).filter("sta <> 'BUILDING' OR net = 1")


@query("duplicate_sta", _nets + "SELECT sta, count(DISTINCT net) AS n_nets FROM q GROUP BY sta HAVING count(DISTINCT net) > 1")
def _(t):
    return group.duplicate_stations(networks(t)).select("sta", "n_nets")


@query("unique_sta", _nets + "SELECT sta, min(net) AS net FROM q GROUP BY sta HAVING count(DISTINCT net) = 1")
def _(t):
    return group.unique_stations(networks(t)).select("sta", F.element_at("nets", 1).alias("net"))


@query("null_net", "SELECT DISTINCT c_mktsegment AS sta FROM customer WHERE c_nationkey = 3")
def _(t):
    return group.stations_without_network(t("customer").select(F.col("c_mktsegment").alias("sta"), F.expr("nullif(c_nationkey, 3)").alias("net")))


@query("force_net", f"WITH {PACKETS} SELECT event_id, CASE WHEN sta = 'U3' AND time BETWEEN 1704500000 AND 1705500000 THEN 'XX' ELSE chan END AS net FROM p")
def _(t):
    df = packets(t).withColumn("net", F.col("chan"))
    return group.set_network(df, "U3", "XX", 1704500000.0, 1705500000.0).select("event_id", "net")


@query("last_wins", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def _(t):
    return group.last_wins(t("orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("best_member", f"WITH {PACKETS} SELECT sta, event_id FROM (SELECT *, row_number() OVER (PARTITION BY sta ORDER BY value DESC, event_id) AS n FROM p) WHERE n = 1")
def _(t):
    return group.best_member(packets(t), ["sta"], "value", ["event_id"]).select("sta", "event_id")


@query(
    "ensemble_bandwidth",
    f"WITH {PACKETS} SELECT sta, coalesce(round(median(value) FILTER (chan <> 'view'), 6), 0.0) AS low, coalesce(round(median(value * 2) FILTER (chan <> 'view'), 6), 0.0) AS high, count(*) FILTER (chan <> 'view') AS n FROM p GROUP BY sta",
)
def _(t):
    df = packets(t).withColumns({"lo": F.when(F.col("chan") != "view", F.col("value")), "hi": F.when(F.col("chan") != "view", F.col("value") * 2)})
    out = group.ensemble_bandwidth(df, ["sta"], "lo", "hi")
    return out.select("sta", rounded("low").alias("low"), rounded("high").alias("high"), "n")


@query("promote_keys", f"WITH {PACKETS} SELECT sta, arg_min(chan, (time, event_id)) AS chan, count(DISTINCT chan) = 1 AS chan_agrees FROM p GROUP BY sta")
def _(t):
    return group.promote(packets(t), ["sta"], ["chan"], ["time", "event_id"])


@query("regularize_sampling", "SELECT event_id, NOT abs(1.0 + (event_id % 7) * 0.0001 - 1.0) > 1.0 / (2.0 * 999) AS live FROM events")
def _(t):
    df = t("events").select("event_id", "user_id", (1.0 + (F.col("event_id") % 7) * 0.0001).alias("dt"), F.lit(1000).alias("npts"))
    return group.regularize_sampling(df, ["user_id"], 1.0).select("event_id", "live")


@query("stack_sum", f"WITH {SERIES}, x AS (SELECT label, unnest(data) AS v, generate_subscripts(data, 1) AS i FROM s) SELECT label, i::INTEGER AS i, round(sum(v), 6) AS x FROM x GROUP BY label, i")
def _(t):
    out = group.stack_sum(series(t), ["label"])
    return out.select("label", F.posexplode("stack").alias("i", "x")).select("label", (F.col("i") + 1).alias("i"), rounded("x").alias("x"))


@query("stack_median", f"WITH {SERIES}, x AS (SELECT label, unnest(data) AS v, generate_subscripts(data, 1) AS i FROM s) SELECT label, i::INTEGER AS i, round(median(v), 6) AS x FROM x GROUP BY label, i")
def _(t):
    out = group.stack_median(series(t), ["label"])
    return out.select("label", F.posexplode("stack").alias("i", "x")).select("label", (F.col("i") + 1).alias("i"), rounded("x").alias("x"))


@query("segment_islands", f"WITH {PACKETS}, {EPOCHS} SELECT sta, segment, starttime, endtime, npackets FROM e")
def _(t):
    return epochs(t).select("sta", "segment", "starttime", "endtime", "npackets")


@query(
    "segment_index_bytes",
    f"""WITH {PACKETS}, {EPOCHS}, o AS (SELECT *, coalesce(sum(length(props)) OVER (PARTITION BY sta ORDER BY time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM h)
    SELECT sta, segment, min(off) AS foff, sum(length(props))::BIGINT AS nbytes FROM o GROUP BY sta, segment""",
)
def _(t):
    df = packets(t).withColumn("nbytes", F.length("props").cast("long"))
    return window.segment_index(df, ["sta"], gap=21600.0, order=["event_id"], size="nbytes").select("sta", "segment", "foff", "nbytes")


@query(
    "file_index",
    f"""WITH RECURSIVE {PACKETS}, f AS (SELECT *, 'F' || (event_id % 20) AS path, row_number() OVER (PARTITION BY event_id % 20 ORDER BY event_id) AS k FROM p),
    r AS (SELECT path, k, chan, time, time AS began, 1::BIGINT AS n, 0::BIGINT AS segment FROM f WHERE k = 1
      UNION ALL SELECT f.path, f.k, f.chan, f.time, CASE WHEN t.tear THEN f.time ELSE r.began END, CASE WHEN t.tear THEN 1 ELSE r.n + 1 END, r.segment + CASE WHEN t.tear THEN 1 ELSE 0 END
      FROM r JOIN f ON f.path = r.path AND f.k = r.k + 1,
      LATERAL (SELECT f.chan <> r.chan OR abs((f.time - r.time) * (1 / 86400.0::DOUBLE) - 1) > 0.5 OR abs((f.time - r.began) * (1 / 86400.0::DOUBLE) - r.n) > 0.5 AS tear) t)
    SELECT path, chan, min(time) AS starttime, max(time) AS last_packet_time, count(*) AS npackets, (min(k) - 1) * 512 AS foff, count(*) * 512 AS nbytes FROM r GROUP BY path, segment, chan""",
)
def _(t):
    from quakeframe.sources.miniseed import index_packets

    own = Window.partitionBy("path").orderBy("event_id")
    p = packets(t).withColumn("path", F.concat(F.lit("F"), (F.col("event_id") % 20).cast("string")))
    codes = {"net": F.lit("XX"), "sta": F.lit("S"), "loc": F.lit(""), "starttime": F.col("time"), "npts": F.lit(1).cast("long"), "rate": F.lit(1 / 86400.0), "foff": (F.row_number().over(own) - 1).cast("long") * 512, "nbytes": F.lit(512).cast("long")}
    return index_packets(p.withColumns(codes)).select("path", "chan", "starttime", "last_packet_time", "npackets", "foff", "nbytes")


@query(
    "gaps_overlaps",
    f"""WITH {PACKETS}, w AS (SELECT event_id, sta, time AS starttime, time + 36000 AS endtime FROM p)
    SELECT event_id, coalesce((starttime - 60.0 - lag(endtime) OVER o) / 60.0 > 0.5, false) AS is_gap, coalesce((starttime - 60.0 - lag(endtime) OVER o) / 60.0 < -0.5, false) AS is_overlap
    FROM w WINDOW o AS (PARTITION BY sta ORDER BY starttime, event_id)""",
)
def _(t):
    df = packets(t).withColumns({"starttime": F.col("time"), "endtime": F.col("time") + 36000, "dt": F.lit(60.0)})
    return window.gaps_and_overlaps(df, ["sta"], order=["event_id"]).select("event_id", "is_gap", "is_overlap")


@query("interval_reader", f"WITH {PACKETS}, {EPOCHS} SELECT sta, segment FROM e WHERE starttime <= 1705500000 AND endtime >= 1705000000")
def _(t):
    return window.in_interval(epochs(t), 1705000000.0, 1705500000.0).select("sta", "segment")


@query("history_alg_reuse", f"WITH {PACKETS} SELECT chan AS alg_name, props AS parameters, count(*) AS uses, min(time) AS first_used FROM p GROUP BY chan, props")
def _(t):
    log = usage(packets(t), "chan", "props", "time")
    return algorithms(log).select("alg_name", "parameters", "uses", "first_used")


@query("history_renamed", f"WITH {PACKETS} SELECT event_id, CASE WHEN chan = 'click' AND props IS NOT DISTINCT FROM (SELECT min(props) FROM p WHERE chan = 'click') THEN 'press' ELSE chan END AS alg_name FROM p")
def _(t):
    p = packets(t)
    log = p.select("event_id", F.col("chan").alias("alg_name"), F.col("props").alias("parameters"), alg_id(F.col("chan"), F.col("props")).alias("alg_id"))
    first = log.filter("alg_name = 'click'").agg(F.min_by("alg_id", "parameters")).first()[0]
    return renamed(log, first, "press", "{}").select("event_id", "alg_name")


@query(
    "history_ancestors",
    """WITH RECURSIVE e AS (SELECT c_custkey AS child, c_custkey // 2 AS parent FROM customer WHERE c_custkey >= 2 UNION SELECT c_custkey, c_custkey // 3 FROM customer WHERE c_custkey >= 3),
    r AS (SELECT child AS id, parent AS ancestor FROM e UNION SELECT r.id, e.parent FROM r JOIN e ON e.child = r.ancestor)
    SELECT id, count(*) AS n, sum(ancestor)::BIGINT AS total, count(*) FILTER (ancestor = 1) AS n_origins FROM r GROUP BY id""",
)
def _(t):
    """Customers as data that were made from two others each: the half and the third of their number. The first customer
    is the one origin that counts; where numbers are missing, others have no parents, too."""
    c = t("customer").select(F.col("c_custkey").cast("long").alias("child"))
    graph = edges(c.filter("child >= 2").withColumn("parent", F.expr("child div 2")), "parent", "child", "half").unionByName(
        edges(c.filter("child >= 3").withColumn("parent", F.expr("child div 3")), "parent", "child", "third")
    )
    reached = ancestors(graph)
    first = origins(graph, reached).filter("ancestor = 1").groupBy("id").agg(F.count("*").alias("n_origins"))
    return reached.groupBy("id").agg(F.count("*").alias("n"), F.sum("ancestor").alias("total")).join(first, "id", "left").select("id", "n", "total", F.coalesce("n_origins", F.lit(0)).alias("n_origins"))


@query(
    "gather_append",
    f"""WITH {SERIES}, m AS (SELECT *, vec_id % 5 = 4 AS late, vec_id % 10 = 9 AS short FROM s)
    SELECT label, count(*)::BIGINT AS size, list(vec_id ORDER BY late, vec_id)::VARCHAR AS ids, round(sum(data[1]), 6) AS total FROM m WHERE NOT short GROUP BY label""",
)
def _(t):
    """Every fifth series comes later; of these every second has lost a sample and is refused."""
    s = series(t)
    gathers = gather.gather(s.filter("vec_id % 5 <> 4"), ["label"], ["vec_id"])
    late = s.filter("vec_id % 5 = 4").withColumn("data", F.when(F.col("vec_id") % 10 == 9, F.slice("data", 1, 63)).otherwise(F.col("data")))
    out = gather.append(gathers, late, ["label"], ["vec_id"])
    ids = F.concat(F.lit("["), F.array_join(F.transform("headers", lambda h: h["vec_id"].cast("string")), ", "), F.lit("]"))
    total = F.aggregate("matrix", F.lit(0.0), lambda a, m: a + m[0])
    return out.select("label", "size", ids.alias("ids"), rounded(total).alias("total"))


@query("push_metadata", f"WITH {PACKETS}, x AS (SELECT sta, max(value) AS top FROM p WHERE chan = 'click' GROUP BY sta) SELECT event_id, coalesce(top, value) AS value, top FROM p LEFT JOIN x USING (sta)")
def _(t):
    p = packets(t)
    tops = p.filter("chan = 'click'").groupBy("sta").agg(F.max("value").alias("value"), F.max("value").alias("top"))
    return group.push_metadata(p, tops, ["sta"]).select("event_id", "value", "top")
