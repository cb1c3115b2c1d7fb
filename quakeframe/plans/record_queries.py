"""Records by themselves: time references, frames of three components, states, histories, and what
tables of stations, waveforms and events become."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quakeframe import history
from quakeframe.functions import arrays as a
from quakeframe.functions import gather
from quakeframe.functions.kernels import common_sum, reduce_groups
from quakeframe.operators import edit, group, undertaker, window
from quakeframe.plans.array_queries import _THREE, three, total
from quakeframe.plans.registry import PACKETS, SERIES, packets, query, rounded, series
from quakeframe.runtime import shared_folder
from quakeframe.schema import Attribute, TableSchema
from quakeframe.sources import lookup, payload, text
from quakeframe.state import ELOG, LIVE, log_error

_S = f"WITH {SERIES} "
_P = f"WITH {PACKETS} "


@query("arrival_times", _P + ", f AS (SELECT *, min(time) OVER (PARTITION BY sta) AS first FROM p) SELECT event_id, round(time - first, 6) AS relative, round(first + (time - first), 3) AS absolute FROM f")
def _(t):
    """Times relative to the first packet of a station, and back."""
    p = packets(t)
    df = p.join(p.groupBy("sta").agg(F.min("time").alias("first")), "sta").withColumn("relative", a.ator("time", "first"))
    return df.select("event_id", rounded("relative").alias("relative"), rounded(a.rtoa("relative", "first"), 3).alias("absolute"))


@query(
    "arrival_window",
    _S + "SELECT vec_id, label <> 0 AS live, CASE WHEN label <> 0 THEN 11 ELSE 64 END AS npts, CASE WHEN label <> 0 THEN round(list_sum(data[label + 1:label + 11]), 6) END AS total, (CASE WHEN label = 0 THEN 1 ELSE 0 END) AS n_log FROM s",
)
def _(t):
    """Five seconds from an arrival on; without one a series dies and keeps its samples."""
    out = payload.arrival_reference(series(t).withColumn("arrival", F.expr("CASE WHEN label <> 0 THEN label * 0.5D END")), "arrival", 0.0, 5.0)
    return out.select("vec_id", "live", F.size("data").alias("npts"), F.when(F.col(LIVE), total()).alias("total"), F.size(ELOG).alias("n_log"))


_SUMS = ", ".join(f"round(list_sum(list_transform(list_zip(x, y, z), lambda v: abs({{{i}}}))), 6) AS {k}" for i, k in enumerate("pqr"))


def sums(c="o"):
    return [total(F.transform(F.col(c)[i], lambda x: F.abs(x))).alias(k) for i, k in enumerate("pqr")]


@query(
    "rotate_frame",
    _THREE + ", m AS (SELECT *, cos(label * 0.3) AS a, sin(label * 0.3) AS b, cos(0.4) AS c0, sin(0.4) AS d0 FROM c JOIN s USING (vec_id)) SELECT vec_id, "
    + _SUMS.format("a * v[1] - b * v[2]", "b * c0 * v[1] + a * c0 * v[2] - d0 * v[3]", "b * d0 * v[1] + a * d0 * v[2] + c0 * v[3]") + " FROM m",
)
def _(t):
    turned = three(t).withColumn("o", a.matrix_times("c", a.rotation(F.col("label") * 0.3, 0.4)))
    return turned.select("vec_id", *sums())


@query("rotate_back", _THREE + "SELECT vec_id, " + _SUMS.format("v[1]", "v[2]", "v[3]") + " FROM c")
def _(t):
    """A shear and a rotation applied, then undone from the matrix that a row carries."""
    flat = F.array(*[F.lit(float(v)) for v in (1, 2, 0, 0, 1, 0)], F.col("label") * 0.5, F.lit(0.25), F.lit(2.0))
    sheared = three(t).withColumn("tmatrix", flat).withColumn("m", a.matrix_times("c", a.from_flat("tmatrix")))
    return sheared.withColumn("o", a.rotate_to_standard("m", "tmatrix")).select("vec_id", *sums())


@query(
    "free_surface",
    _THREE + ", u AS (SELECT *, vec_id % 10 * 0.01 AS ux, 0.02 AS uy, 6.0 AS vp, 3.5 AS vs FROM c), "
    "w AS (SELECT *, ux * ux + uy * uy AS p2, sqrt(ux * ux + uy * uy) AS p FROM u), "
    "k AS (SELECT *, (1 - 2 * vs * vs * p2) / (2 * vp * sqrt(1 / (vp * vp) - p2)) AS vpz, p * vs * vs / vp AS vpr, (1 - 2 * vs * vs * p2) / (2 * vs * sqrt(1 / (vs * vs) - p2)) AS vsr, p * vs AS vsz, ux / p AS e, uy / p AS n FROM w) SELECT vec_id, "
    + _SUMS.format("-0.5 * n * v[1] + 0.5 * e * v[2]", "vsr * e * v[1] + vsr * n * v[2] - vsz * v[3]", "vpr * e * v[1] + vpr * n * v[2] + vpz * v[3]") + " FROM k",
)
def _(t):
    m = a.free_surface_matrix((F.col("vec_id") % 10) * 0.01, F.lit(0.02), F.lit(6.0), F.lit(3.5))
    return three(t).withColumn("o", a.matrix_times("c", m)).select("vec_id", *sums())


@query(
    "oriented_channels",
    _THREE + ", m AS (SELECT *, cos(radians(label * 7.0)) AS a, sin(radians(label * 7.0)) AS b FROM c JOIN s USING (vec_id)) SELECT vec_id, " + _SUMS.format("a * v[1] + b * v[2]", "a * v[2] - b * v[1]", "-v[3]") + " FROM m",
)
def _(t):
    """Horizontal channels off their axes by an angle, and a vertical one that points down."""
    off = F.col("label") * 7.0
    df = three(t).withColumns({"hang": F.array(off + 90.0, off, F.lit(0.0)), "vang": F.array(F.lit(90.0), F.lit(90.0), F.lit(180.0))})
    return df.withColumn("o", a.oriented("c", "hang", "vang")).select("vec_id", *sums())


_CODES = "CASE WHEN event_id % 5 > 0 THEN 'N' || (event_id % 5) END"


@query("seed_sorted", _P + f"SELECT event_id, row_number() OVER (PARTITION BY sta, floor(time / 86400) ORDER BY {_CODES} DESC NULLS LAST, chan DESC NULLS LAST, event_id)::INTEGER AS ordinal FROM p")
def _(t):
    """The members of a station's day by their codes; those without a network come last."""
    p = packets(t).withColumns({"net": F.expr(_CODES), "loc": F.lit("00")})
    own = Window.partitionBy("sta", F.floor(F.col("time") / 86400)).orderBy(*group.seed_order(), "event_id")
    return p.select("event_id", F.row_number().over(own).alias("ordinal"))


@query(
    "gap_flags",
    _S + "SELECT vec_id, label % 3 >= 1 AS second, false AS none, label % 3 = 2 AS third, label % 4 = 0 AS meets FROM s",
)
def _(t):
    """Gaps of a second from 5, 10 and 15 on, as many as a label has; intervals are closed."""
    gaps = F.expr("transform(sequence(1, label % 3 + 1), k -> named_struct('starttime', k * 5.0D, 'endtime', k * 5.0D + 1))")
    df = series(t).withColumns({"gaps": gaps, "starttime": (F.col("label") % 4).cast("double") * 10, "endtime": (F.col("label") % 4).cast("double") * 10 + 3})
    flag = lambda s, e: window.has_gap(F.col("gaps"), F.lit(s), F.lit(e))
    inside = window.in_interval(df, 3.0, 9.5).select("vec_id", F.lit(True).alias("meets"))
    out = df.select("vec_id", flag(9.5, 10.0).alias("second"), flag(6.5, 9.0).alias("none"), flag(16.0, 20.0).alias("third"))
    return out.join(inside, "vec_id", "left").withColumn("meets", F.coalesce("meets", F.lit(False)))


@query("mummies", _S + "SELECT vec_id, label <> 2 AS live, CASE WHEN label = 2 THEN 0 ELSE 64 END AS npts, CASE WHEN label = 2 THEN 0.0 ELSE round(list_sum(data), 6) END AS total FROM s")
def _(t):
    out = undertaker.mummify(edit.MetadataEQ("label", 2).apply(series(t)))
    return out.select("vec_id", "live", F.size("data").alias("npts"), total().alias("total"))


@query("cremated", _S + "SELECT label, count(*) AS n, sum(vec_id)::BIGINT AS ids FROM s WHERE label <= 4 GROUP BY label")
def _(t):
    return undertaker.cremate(edit.MetadataGT("label", 4).apply(series(t))).groupBy("label").agg(F.count("*").alias("n"), F.sum("vec_id").alias("ids"))


@query("abortions", _S + "SELECT 'TimeSeries' AS type, vec_id, label::BIGINT AS label, 'label gt 7' AS message FROM s WHERE label > 7")
def _(t):
    """Records of series that could not be made, without samples."""
    dead = undertaker.abortions(edit.MetadataGT("label", 7).apply(series(t)), "TimeSeries")
    field = lambda k: F.get_json_object("tombstone", f"$.{k}").cast("long").alias(k)
    return dead.filter("tombstone NOT LIKE '%\"data\":%'").select("type", field("vec_id"), field("label"), F.element_at("logdata", 1)["message"].alias("message"))


@query("complaints", _P + "SELECT event_id, true AS live, CASE WHEN value > 100 THEN 'large' END AS message, CASE WHEN value > 100 THEN 'Complaint' END AS badness FROM p")
def _(t):
    """A complaint is logged and kills nothing."""
    last = F.try_element_at(ELOG, F.lit(-1))
    return log_error(packets(t), F.col("value") > 100, "check", "large").select("event_id", "live", last["message"].alias("message"), last["badness"].alias("badness"))


@query(
    "channel_reports",
    _P + "SELECT sta, chan, event_id, strftime(make_timestamp((floor(time) * 1000000)::BIGINT), '%Y-%m-%d %H:%M:%S') AS \"from\", strftime(make_timestamp(((floor(time) + 3600) * 1000000)::BIGINT), '%Y-%m-%d %H:%M:%S') AS \"to\" FROM p WHERE chan = 'click' AND floor(time) > 1706000000 - 864000 AND floor(time) < 1706000000",
)
def _(t):
    """Epochs of one channel code that begin within ten days, with times as text."""
    start = F.floor("time").cast("double")
    rows = packets(t).select("sta", "chan", F.col("event_id").alias("lat"), start.alias("starttime"), (start + 3600).alias("endtime"))
    recent = rows.filter(f"starttime > {1706000000 - 864000} AND starttime < 1706000000")
    return lookup.report(recent, chan="click").withColumnRenamed("lat", "event_id")


_CHANNELS = """c AS (SELECT event_id, CASE event_id % 3 WHEN 1 THEN '' WHEN 2 THEN '00' END AS loc, floor(time) AS starttime FROM p WHERE sta = 'U3' AND chan = 'click'
    AND floor(time) < 1706000000 AND floor(time) + 2592000 > 1706000000)"""


def channels(t):
    start = F.floor("time").cast("double")
    return packets(t).select(
        F.lit("N").alias("net"), "sta", "chan", F.expr("CASE event_id % 3 WHEN 1 THEN '' WHEN 2 THEN '00' END").alias("loc"), start.alias("starttime"),
        (start + 2592000).alias("endtime"), F.col("event_id").alias("_id"), F.concat(F.lit("r"), F.col("event_id")).alias("response"),
    )


@query("seed_channel", _P + f", {_CHANNELS} SELECT event_id, count(*) OVER () AS n_matches FROM c ORDER BY CASE WHEN loc IS NULL THEN 0 WHEN loc = '' THEN 1 ELSE 2 END, starttime, event_id LIMIT 1")
def _(t):
    """Among channels of several location codes one without a code comes first."""
    return lookup.seed_channel(channels(t), "N", "U3", "click", time=1706000000.0).select(F.col("_id").alias("event_id"), "n_matches")


@query("channel_response", _P + f", {_CHANNELS} SELECT 'r' || event_id AS response, count(*) OVER () AS n_matches FROM c WHERE loc = '00' ORDER BY starttime, event_id LIMIT 1")
def _(t):
    return lookup.response(channels(t), "N", "U3", "click", 1706000000.0, "00")


@query(
    "reduce_pairs",
    _S + ", m AS (SELECT label, vec_id // 50 AS part, vec_id, label = 3 AND row_number() OVER (PARTITION BY label, vec_id // 50 ORDER BY vec_id) = 2 AS bad, data FROM s) "
    "SELECT label, part, count(*) AS n_members, NOT bool_or(bad) AS live, CASE WHEN NOT bool_or(bad) THEN round(sum(list_sum(data)), 6) END AS total, CASE WHEN bool_or(bad) THEN 'unequal' END AS message FROM m GROUP BY label, part",
)
def _(t):
    """Sums of ensembles pair by pair; a member of another length ends its ensemble."""
    own = Window.partitionBy("label", "part").orderBy("vec_id")
    df = series(t).withColumn("part", F.expr("vec_id div 50")).withColumn("n", F.row_number().over(own))
    df = df.withColumn("data", F.when((F.col("label") == 3) & (F.col("n") == 2), F.slice("data", 1, 63)).otherwise(F.col("data")))

    def pairwise(x, y):
        if len(x) != len(y):
            raise ValueError("unequal")
        return common_sum(x, y)

    out = reduce_groups(df, pairwise, ["label", "part"], ["vec_id"])
    return out.select("label", "part", "n_members", "live", F.when(F.col(LIVE), total()).alias("total"), F.try_element_at(ELOG, F.lit(1))["message"].alias("message"))


@query(
    "gather_members",
    _S + ", m AS (SELECT label, vec_id // 100 AS part, vec_id, data, row_number() OVER (PARTITION BY label, vec_id // 100 ORDER BY vec_id) AS k FROM s WHERE label >= 2) "
    "SELECT label, part, count(*) FILTER (k BETWEEN 2 AND 4) AS size, min(vec_id) FILTER (k = 2) AS head, round(max(list_sum(data)) FILTER (k = 2), 6) AS total FROM m GROUP BY label, part",
)
def _(t):
    """Dense ensembles written, read by a filter, and cut to their members 1 to 3."""
    made = gather.gather(series(t).withColumn("part", F.expr("vec_id div 100")), ["label", "part"], ["vec_id"])
    path = shared_folder(made.sparkSession, "gathers")
    gather.save_gathers(made, path)
    out = gather.subset(gather.read_gathers(made.sparkSession, path, {"label": {"$gte": 2}}), 1, 4)
    return out.select("label", "part", "size", F.get("headers", F.lit(0))["vec_id"].alias("head"), total(gather.member("matrix", 0)).alias("total"))


@query("unfolded_members", _S + "SELECT vec_id, label, round(list_sum(data), 6) AS total FROM s")
def _(t):
    """Ensembles of a hundred taken apart again."""
    folded = group.fold(series(t).withColumn("part", F.expr("vec_id div 100")), ["label", "part"], ["vec_id"])
    return group.unfold(folded).select("vec_id", "label", total().alias("total"))


@query("regularized_members", _S + "SELECT vec_id, 66 AS npts, round(list_sum(data) - CASE WHEN label > 4 THEN data[64] ELSE 0 END, 6) AS total FROM s WHERE label <= 7")
def _(t):
    """Members on one range: short of a sample they are padded, short of many they leave."""
    cut = F.expr("slice(data, 1, CASE WHEN label > 7 THEN 40 WHEN label > 4 THEN 63 ELSE 64 END)")
    out = window.regularize_members(series(t).withColumn("data", cut), 0.0, 32.5, 0.05)
    return out.select("vec_id", F.size("data").alias("npts"), total().alias("total"))


@query(
    "waveform_index",
    _P + ", m AS (SELECT 'U' || c_custkey AS fsta, 'N' || c_nationkey AS snet, 'S' || c_custkey AS mapped FROM customer WHERE c_custkey % 2 = 0) "
    "SELECT event_id, coalesce(snet, 'XX') AS net, coalesce(mapped, sta) AS sta, chan, CASE WHEN event_id % 2 = 0 THEN '00' END AS loc FROM p LEFT JOIN m ON p.sta = m.fsta WHERE event_id % 4 <> 1",
)
def _(t):
    """Rows of a waveform index: two of four data types, codes by a station map or a default."""
    wfdisc = packets(t).select("event_id", "sta", F.expr("chan || CASE WHEN event_id % 2 = 0 THEN '_00' ELSE '' END").alias("chan"), F.expr("array('sd', 's4', 'S1', 'sd')[event_id % 4]").alias("datatype"))
    stations = t("customer").filter("c_custkey % 2 = 0").select(F.concat(F.lit("U"), "c_custkey").alias("fsta"), F.concat(F.lit("N"), "c_nationkey").alias("snet"), F.concat(F.lit("S"), "c_custkey").alias("sta"))
    return text.waveform_rows(wfdisc, stations, "XX").select("event_id", "net", "sta", "chan", "loc")


@query("whitespace_table", "SELECT o_orderkey AS evid, o_custkey AS sta, round(o_totalprice, 2) AS time, CASE WHEN o_orderkey % 7 <> 0 THEN (o_custkey % 10)::INTEGER END AS phase, 'x' AS source FROM orders")
def _(t):
    """Lines of columns apart by blanks, written and read; what is no number is a null."""
    o = t("orders")
    path = shared_folder(o.sparkSession, "lines")
    phase = F.expr("CASE WHEN o_orderkey % 7 = 0 THEN '-' ELSE string(o_custkey % 10) END")
    o.select(F.concat(F.lit("  "), F.concat_ws("   ", F.col("o_orderkey"), F.col("o_custkey"), F.format_string("%.2f", "o_totalprice"), phase))).write.text(path)
    kinds = {"evid": o.schema["o_orderkey"].dataType.simpleString(), "sta": o.schema["o_custkey"].dataType.simpleString(), "time": "double", "phase": "int"}
    return text.read_whitespace_table(o.sparkSession, path, ["evid", "sta", "time", "phase"], types=kinds, constants={"source": "x"})


@query(
    "catalog_flattened",
    """WITH o AS (SELECT l_orderkey AS evid, l_linenumber AS id, l_quantity AS lat, l_discount AS lon, l_extendedprice AS depth, l_tax AS time FROM lineitem),
    k AS (SELECT *, row_number() OVER (PARTITION BY evid ORDER BY (evid % 2 = 0 AND id = 2) DESC, id, lat, lon, depth, time) AS rank FROM o)
    SELECT evid, lat, lon, depth, time, round(evid % 10 / 2.0, 1) AS magnitude FROM k WHERE rank = 1""",
)
def _(t):
    """Events with the lines of an order as origins; every second one prefers its second, if it has one."""
    origin = F.struct(F.col("l_linenumber").alias("id"), F.col("l_quantity").alias("lat"), F.col("l_discount").alias("lon"), F.col("l_extendedprice").alias("depth"), F.col("l_tax").alias("time"))
    events = t("lineitem").groupBy(F.col("l_orderkey").alias("evid")).agg(F.array_sort(F.collect_list(origin)).alias("origins"))
    events = events.withColumns({"preferred": F.expr("CASE WHEN evid % 2 = 0 THEN 2 END"), "magnitudes": F.array(F.round(F.col("evid") % 10 / 2.0, 1), F.lit(9.9))})
    return payload.flatten_catalog(events)


@query("aliases_applied", _P + "SELECT event_id, sta AS station, time AS start, chan AS chan FROM p")
def _(t):
    """Attributes under given aliases; the schema gives the definitive name of each."""
    schema = TableSchema("wf", {k: Attribute(k, kind, aliases=names) for k, kind, names in (("sta", "string", ("station",)), ("time", "double", ("start", "t0")), ("chan", "string", ()))})
    names = {schema.unique_name(alias): alias for alias in ("station", "start")}
    return schema.apply_aliases(packets(t).select("event_id", "sta", "time", "chan"), names)


@query(
    "history_stages",
    "SELECT vec_id, CASE WHEN label > 4 THEN 2 ELSE 1 END AS stages, substr(sha256('detrend' || chr(1) || 'type=linear'), 1, 24) AS first_id, CASE WHEN label > 4 THEN substr(sha256('filter' || chr(1) || ''), 1, 24) END AS second_id FROM embeddings",
)
def _(t):
    """What was done to each series: to some one thing more."""
    once = history.stage(t("embeddings").select("vec_id", "label"), "detrend", "type=linear")
    both = history.stage(once.filter("label > 4"), "filter").unionByName(once.filter("label <= 4"))
    ident = lambda i: F.get("history", F.lit(i))["alg_id"]
    return both.select("vec_id", F.get("history", F.size("history") - 1)["stage"].alias("stages"), ident(0).alias("first_id"), ident(1).alias("second_id"))
