"""Verification, repair, import and table maintenance over the driver's tables."""

from pyspark.sql import functions as F

from quakeframe.operators import quality
from quakeframe.plans.registry import query
from quakeframe.schema import conform, table_schema
from quakeframe.sources import tables, text
from quakeframe.state import LIVE

PART = table_schema(
    "part",
    {
        "p_partkey": {"type": "int", "constraint": "required"},
        "p_size": {"type": "int", "constraint": "required", "aliases": ["size"]},
        "p_brand": {"type": "string"},
        "p_code": {"type": "int"},
    },
)


@query("check_links", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, 'bad' AS problem FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def _(t):
    parents = t("orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("_id"))
    return quality.check_links(t("lineitem"), "l_orderkey", parents).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "problem")


@query("check_links_missing", "SELECT event_id, CASE WHEN user_id % 5 = 0 THEN 'missing' ELSE 'bad' END AS problem FROM events WHERE user_id % 5 = 0 OR user_id > 100")
def _(t):
    df = t("events").select("event_id", F.expr("CASE WHEN user_id % 5 <> 0 THEN user_id END").alias("source_id"))
    parents = t("events").filter("user_id <= 100").select(F.col("user_id").alias("_id"))
    return quality.check_links(df, "source_id", parents).select("event_id", "problem")


def coded(t):
    """Parts with missing sizes, and a code that is a number for some brands only."""
    return t("part").select("p_partkey", F.expr("nullif(p_size, 7)").alias("p_size"), "p_brand", F.expr("CASE WHEN p_size % 2 = 0 THEN cast(p_size AS string) ELSE p_brand END").alias("p_code"))


@query("check_required", "SELECT p_partkey, 'p_size' AS undefined FROM part WHERE p_size = 7")
def _(t):
    out = quality.check_required(coded(t), PART)
    return out.select("p_partkey", F.array_join("undefined_keys", ",").alias("undefined"))


@query("check_types", "SELECT p_partkey, 'p_code' AS wrong FROM part WHERE p_size % 2 <> 0")
def _(t):
    return quality.check_types(coded(t), PART).select("p_partkey", F.array_join("wrong_keys", ",").alias("wrong"))


@query("verify_rows", "SELECT p_partkey, CASE WHEN p_size = 7 THEN 'undefined' ELSE '' END AS size_tests, CASE WHEN p_size % 2 <> 0 THEN 'type' ELSE '' END AS code_tests FROM part")
def _(t):
    out = quality.verify(coded(t), PART)
    tests = lambda k: F.coalesce(F.array_join(F.col("failures")[k], ","), F.lit(""))
    return out.select("p_partkey", tests("p_size").alias("size_tests"), tests("p_code").alias("code_tests"))


@query("fix_types", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size::BIGINT END AS p_code FROM part")
def _(t):
    return quality.fix_types(coded(t), PART)[0].select("p_partkey", "p_code")


@query("fix_types_counts", "SELECT count(*) FILTER (p_size % 2 = 0) AS p_code_fixed, count(*) FILTER (p_size % 2 <> 0) AS p_code_lost FROM part")
def _(t):
    return quality.fix_types(coded(t), PART)[1].select("p_code_fixed", "p_code_lost")


@query("rename_counts", "SELECT count(nullif(p_size, 7)) AS p_size, count(p_brand) AS p_brand FROM part")
def _(t):
    return quality.rename_attributes(coded(t), {"p_size": "size", "p_brand": "brand", "absent": "x"})[1]


@query("delete_counts", "SELECT count(nullif(p_size, 7)) AS p_size FROM part")
def _(t):
    return quality.delete_attributes(coded(t), ["p_size", "absent"])[1]


@query("clean_rows", "SELECT p_partkey, p_size::BIGINT AS p_size, p_brand, CASE WHEN p_size % 2 = 0 THEN p_size::BIGINT END AS p_code FROM part WHERE p_size <> 7")
def _(t):
    df = coded(t).withColumnRenamed("p_size", "size").withColumn("junk", F.lit(1))
    return quality.clean(df, PART, delete_undefined=True, delete_missing_required=True)[0].select("p_partkey", "p_size", "p_brand", "p_code")


for _mode, _live in (("promiscuous", "true"), ("cautious", "p_size <> 7"), ("pedantic", "p_size <> 7 AND p_size % 2 = 0")):

    @query(f"save_mode_{_mode}", f"SELECT p_partkey, {_live} AS live FROM part")
    def _save(t, mode=_mode):
        return conform(coded(t).withColumnRenamed("p_size", "size"), PART, mode).select("p_partkey", LIVE)


@query("clear_aliases", "SELECT p_partkey, p_size FROM part")
def _(t):
    return PART.clear_aliases(t("part").select("p_partkey", F.col("p_size").alias("size")))


@query("clean_dedupe", "SELECT DISTINCT text, lang, source FROM documents")
def _(t):
    return text.saved(t("documents").select("text", "lang", "source"))


@query("save_dataframe_nulls", "SELECT DISTINCT nullif(lang, 'en') AS lang, nullif(source, 'src1') AS source FROM documents")
def _(t):
    return text.saved(t("documents").select("lang", "source"), {"lang": "en", "source": "src1"}).distinct()


@query("text_import_order", "SELECT DISTINCT CASE WHEN n_chars > 2000 THEN NULL ELSE lang END AS language, 'wf' AS kind, n_chars // 1000 AS size FROM documents")
def _(t):
    df = t("documents").select(F.expr("CASE WHEN n_chars > 2000 THEN '-' ELSE lang END").alias("lang"), F.expr("cast(n_chars div 1000 AS string)").alias("size"), "text")
    return text.imported(df, types={"size": "long"}, nulls={"lang": "-"}, use=["lang", "size"], rename={"lang": "language"}, constants={"kind": "wf"}).select("language", "kind", "size")


@query("fixed_width_round_trip", "SELECT s_suppkey, s_nationkey::BIGINT AS s_nationkey, round(s_acctbal, 2) AS s_acctbal FROM supplier")
def _(t):
    layout = text.parse_layout("s_suppkey 10 0 int -1\ns_nationkey 6 11 int -1\ns_acctbal 14 18 float -99999999.0")
    lines = text.fixed_width_lines(t("supplier"), [text.FixedColumn(c.name, c.width, c.offset, c.type, c.null, "%14.2f" if c.type == "double" else None) for c in layout])
    back = [F.trim(F.substring("value", c.offset + 1, c.width)).try_cast(c.type).alias(c.name) for c in layout]
    return lines.select(*back)


@query("query_translation", "SELECT event_id FROM events WHERE (user_id >= 10 AND user_id < 40 AND (event_type IN ('click', 'error') OR value > 150)) AND NOT coalesce(user_id = 20, false)")
def _(t):
    q = {"user_id": {"$gte": 10, "$lt": 40, "$not": {"$eq": 20}}, "$or": [{"event_type": {"$in": ["click", "error"]}}, {"value": {"$gt": 150}}]}
    return tables.read_data(t("events"), q).select("event_id")


@query("read_ensembles", "SELECT 0 AS ensemble, event_id FROM events WHERE user_id = 3 UNION ALL SELECT 1, event_id FROM events WHERE value > 150")
def _(t):
    return tables.read_ensembles(t("events"), [{"user_id": 3}, {"value": {"$gt": 150}}]).select("ensemble", "event_id")


@query("update_rows", "SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT -1, 5.0")
def _(t):
    spark = t("customer").sparkSession
    changes = t("customer").filter("c_nationkey = 3").select("c_custkey", F.lit(0.0).alias("c_acctbal")).unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("c_custkey"), F.lit(5.0).alias("c_acctbal")))
    return tables.updated(t("customer").select("c_custkey", "c_acctbal"), changes, "c_custkey")


@query("delete_rows", "SELECT c_custkey FROM customer WHERE c_nationkey <> 3")
def _(t):
    return tables.deleted(t("customer"), t("customer").filter("c_nationkey = 3"), "c_custkey")[0].select("c_custkey")


@query(
    "delete_orphan_files",
    "SELECT dir, dfile FROM (SELECT c_mktsegment AS dir, (c_custkey % 50)::VARCHAR AS dfile, c_nationkey FROM customer) GROUP BY dir, dfile HAVING bool_and(c_nationkey < 20)",
)
def _(t):
    df = t("customer").select("c_custkey", F.col("c_mktsegment").alias("dir"), (F.col("c_custkey") % 50).cast("string").alias("dfile"), "c_nationkey")
    return tables.deleted(df, df.filter("c_nationkey < 20"), "c_custkey")[1]


@query("inventory_new_rows", "SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0")
def _(t):
    rows = t("supplier").select("s_suppkey", F.col("s_name").alias("sta"), F.col("s_suppkey").cast("double").alias("starttime"), (F.col("s_suppkey") + 1000.0).alias("endtime"))
    known = rows.filter("s_suppkey % 3 <> 0").withColumn("starttime", F.col("starttime") + 9.5)
    return tables.new_inventory_rows(rows, known, ["sta"]).select("s_suppkey")


@query(
    "header_offsets",
    "SELECT event_id, coalesce(sum((user_id % 5 + 1) * 24) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS foff FROM events",
)
def _(t):
    from quakeframe.sources.payload import header_offsets

    df = t("events").select("event_id", "event_type", (F.col("user_id") % 5 + 1).alias("npts"))
    return header_offsets(df, ["event_type"], ["event_id"]).select("event_id", F.col("foff").cast("long").alias("foff"))


def record_files(t):
    """The embeddings as series in files, ten folders of seven files; the folder and its header table."""
    from quakeframe.plans.registry import series
    from quakeframe.runtime import shared_folder
    from quakeframe.sources.byterange import save_records

    root = shared_folder(t("embeddings").sparkSession, "records")
    rows = series(t).select("vec_id", "label", F.expr("'L' || label AS dir"), F.expr("'F' || (vec_id % 7) AS dfile"), "data")
    save_records(rows, f"{root}/files", f"{root}/header", ["vec_id"])
    return f"{root}/files", f"{root}/header"


@query(
    "byte_range_records",
    """SELECT vec_id, label, 'L' || label AS dir, (row_number() OVER (PARTITION BY label, vec_id % 7 ORDER BY vec_id) - 1) * 512 AS foff, 64::BIGINT AS npts, round(list_sum([x::DOUBLE FOR x IN embedding]), 6) AS total, true AS live
    FROM embeddings WHERE label >= 3""",
)
def _(t):
    """Written and read again by byte ranges; files of other labels are not opened."""
    from quakeframe.sources.byterange import read_records

    root, header = record_files(t)
    out = read_records(t("embeddings").sparkSession, header, root, where=[("label", ">=", 3)])
    total = F.round(F.aggregate("data", F.lit(0.0), lambda a, x: a + x), 6)
    return out.select("vec_id", "label", "dir", "foff", F.size("data").cast("long").alias("npts"), total.alias("total"), LIVE)


@query(
    "byte_range_parts",
    """SELECT vec_id, CASE WHEN vec_id % 10 > 0 THEN 10 ELSE 0 END::BIGINT AS npts, CASE WHEN vec_id % 10 > 0 THEN round(list_sum([x::DOUBLE FOR x IN embedding[21:30]]), 6) END AS total, vec_id % 10 > 0 AS live FROM embeddings""",
)
def _(t):
    """Ten samples from the twentieth on, of headers that are a DataFrame; every tenth names a range
    beyond its file and dies."""
    from quakeframe.sources.byterange import read_samples

    root, header = record_files(t)
    place = F.when(F.col("vec_id") % 10 > 0, F.col("foff") + 160).otherwise(F.col("foff") + 1_000_000_000)
    heads = t("embeddings").sparkSession.read.parquet(header).select("vec_id", "dir", "dfile", place.alias("foff"), F.lit(10).alias("npts"))
    out = read_samples(heads, root)
    total = F.when(F.col(LIVE), F.round(F.aggregate("data", F.lit(0.0), lambda a, x: a + x), 6))
    return out.select("vec_id", F.size("data").cast("long").alias("npts"), total.alias("total"), LIVE)


@query("seed_lookup", "SELECT event_id, count(*) OVER () AS n_matches FROM events WHERE user_id = 3 AND epoch_us(ts) / 1e6 < 1705000000 AND epoch_us(ts) / 1e6 + 86400 > 1705000000 ORDER BY epoch_us(ts), event_id LIMIT 1")
def _(t):
    from quakeframe.plans.registry import packets
    from quakeframe.sources.lookup import seed_site

    site = packets(t).select(F.lit("N").alias("net"), "sta", F.lit("").alias("loc"), F.col("time").alias("starttime"), (F.col("time") + 86400).alias("endtime"), F.col("event_id").alias("_id"))
    return seed_site(site, "N", "U3", time=1705000000.0).select(F.col("_id").alias("event_id"), "n_matches")


@query(
    "network_from_sites",
    """WITH s AS (SELECT user_id, min(epoch_us(ts) / 1e6) AS a, max(epoch_us(ts) / 1e6) AS z FROM events WHERE event_type = 'error' GROUP BY user_id)
    SELECT event_id, CASE WHEN s.user_id IS NOT NULL THEN 'N' || (e.user_id % 3) END AS net, CASE WHEN s.user_id IS NOT NULL THEN 1 ELSE 0 END::BIGINT AS n_sites
    FROM events e LEFT JOIN s ON e.user_id = s.user_id AND epoch_us(ts) / 1e6 > a AND epoch_us(ts) / 1e6 < z""",
)
def _(t):
    from quakeframe.plans.registry import packets
    from quakeframe.sources.lookup import network_from_sites

    p = packets(t).join(t("events").select("event_id", "user_id"), "event_id")
    site = p.filter("chan = 'error'").groupBy("sta").agg(F.min("time").alias("starttime"), F.max("time").alias("endtime"), F.concat(F.lit("N"), (F.first("user_id") % 3).cast("string")).alias("net"))
    rows = p.select("event_id", "sta", "time", F.lit(None).cast("string").alias("net"))
    return network_from_sites(rows, site).select("event_id", "net", "n_sites")


@query("link_sources", "SELECT x.event_id, (SELECT y.event_id FROM events y WHERE y.event_type = 'purchase' AND abs(epoch_us(y.ts) - epoch_us(x.ts)) <= 600000000 ORDER BY y.ts DESC, y.event_id DESC LIMIT 1) AS source_id FROM events x WHERE x.event_type = 'error'")
def _(t):
    from quakeframe.plans.registry import packets
    from quakeframe.sources.lookup import link_sources

    p = packets(t)
    sources = p.filter("chan = 'purchase'").select(F.col("event_id").alias("_id"), "time")
    return link_sources(p.filter("chan = 'error'"), sources, 600.0, "time").select("event_id", "source_id")


@query(
    "link_sources_repeated",
    """WITH w AS (SELECT nullif(user_id % 4, 0) AS k, floor(epoch_us(ts) / 6e8) * 600.0 AS t FROM events),
    s AS (SELECT event_id AS id, epoch_us(ts) / 1e6 AS t, CASE WHEN user_id % 3 = 0 THEN user_id END AS evid FROM events WHERE event_type = 'purchase'),
    h AS (SELECT w.t, max_by(s.id, (s.t, s.id)) AS late, min_by(s.id, (s.t, s.id)) FILTER (evid IS NOT NULL) AS early FROM (SELECT DISTINCT t FROM w) w JOIN s ON abs(s.t - w.t) <= 900 GROUP BY w.t)
    SELECT k, w.t AS time, coalesce(early, late) AS source_id, s.evid FROM w LEFT JOIN h ON w.t = h.t LEFT JOIN s ON s.id = coalesce(early, late)""",
)
def _(t):
    """Rows repeat both their (sometimes null) key and their time; each stays."""
    from quakeframe.plans.registry import packets
    from quakeframe.sources.lookup import link_sources

    p = packets(t).join(t("events").select("event_id", "user_id"), "event_id")
    sources = p.filter("chan = 'purchase'").select(F.col("event_id").alias("_id"), "time", F.expr("CASE WHEN user_id % 3 = 0 THEN user_id END AS evid"))
    rows = p.select(F.expr("nullif(user_id % 4, 0) AS k"), (F.floor(F.col("time") / 600) * 600.0).alias("time"))
    return link_sources(rows, sources, 900.0, "time", prefer_evid=True).select("k", "time", "source_id", "evid")


@query(
    "arrival_networks",
    """WITH e AS (SELECT 'U' || user_id AS sta, 'N' || (event_id % 3) AS net, epoch_us(ts) / 1e6 AS a, epoch_us(ts) / 1e6 + 40000 + event_id % 7 * 30000 AS z FROM events WHERE event_type = 'error')
    SELECT event_id, (SELECT e.net FROM e WHERE e.sta = 'U' || p.user_id AND epoch_us(p.ts) / 1e6 BETWEEN e.a AND e.z ORDER BY e.a DESC, e.net LIMIT 1) AS net FROM events p""",
)
def _(t):
    from quakeframe.plans.registry import packets
    from quakeframe.sources.lookup import arrival_networks

    p = packets(t)
    site = p.filter("chan = 'error'").select("sta", F.expr("'N' || (event_id % 3) AS net"), F.col("time").alias("starttime"), F.expr("time + 40000 + event_id % 7 * 30000 AS endtime"))
    return arrival_networks(p.select("event_id", "sta", "time"), site, allowed_overlap=1e9).select("event_id", "net")


@query("apply_calib", "SELECT event_id, round(CASE WHEN user_id % 4 <> 0 THEN value * (user_id % 4) ELSE value END, 6) AS x, user_id % 4 <> 0 AS live FROM events")
def _(t):
    from quakeframe.sources.lookup import apply_calib

    df = t("events").select("event_id", (F.col("user_id") % 4).alias("channel_id"), F.array("value").alias("data"))
    calibs = df.filter("channel_id <> 0").select(F.col("channel_id").alias("_id"), F.col("channel_id").cast("double").alias("calib")).distinct()
    return apply_calib(df, calibs).select("event_id", F.round(F.col("data")[0], 6).alias("x"), "live")


@query(
    "network_repeated_rows",
    """WITH s AS (SELECT DISTINCT 'U' || user_id AS sta, 'N' || (event_id % 2) AS net FROM events WHERE event_type = 'error' AND user_id < 90), c AS (SELECT sta, count(*) AS n, min(net) AS net FROM s GROUP BY sta)
    SELECT e.user_id, coalesce(c.n, 0)::BIGINT AS n_sites, CASE WHEN e.user_id % 7 = 0 THEN 'OLD' WHEN c.n = 1 THEN c.net END AS net FROM events e LEFT JOIN c ON c.sta = 'U' || e.user_id""",
)
def _(t):
    from quakeframe.sources.lookup import network_from_sites

    e = t("events")
    ever = {"starttime": F.lit(0.0), "endtime": F.lit(9e9)}
    site = e.filter("event_type = 'error' AND user_id < 90").select(F.expr("'U' || user_id AS sta"), F.expr("'N' || (event_id % 2) AS net")).withColumns(ever)
    rows = e.select("user_id", F.expr("'U' || user_id AS sta"), F.lit(1.0).alias("time"), F.expr("CASE WHEN user_id % 7 = 0 THEN 'OLD' END AS net"))  # rows repeat
    return network_from_sites(rows, site).select("user_id", "n_sites", "net")


@query(
    "repeated_source_ids",
    "SELECT o_orderkey, (SELECT min(c_name) FROM customer WHERE c_nationkey = o_custkey % 30) AS source_id FROM orders",
)
def _(t):
    from quakeframe.operators.group import set_source_id

    sources = t("customer").select(F.col("c_nationkey").cast("long").alias("evid"), F.col("c_name").alias("_id"))  # ids repeat
    return set_source_id(t("orders").select("o_orderkey", (F.col("o_custkey") % 30).alias("evid")), sources)[0].select("o_orderkey", "source_id")


@query(
    "update_repeated",
    "SELECT c_custkey, coalesce((SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey), c_acctbal) AS c_acctbal FROM customer",
)
def _(t):
    from quakeframe.sources.tables import updated

    changes = t("orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal")).join(t("customer").select("c_custkey"), "c_custkey", "left_semi")
    return updated(t("customer").select("c_custkey", "c_acctbal"), changes, "c_custkey", order=["c_acctbal"])


@query(
    "update_partial",
    """WITH o AS (SELECT o_custkey AS k, o_orderdate AS d, o_orderkey AS n, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS status FROM orders),
    l AS (SELECT k, arg_max(price, (d, n)) FILTER (price IS NOT NULL) AS price, arg_max(status, (d, n)) FILTER (status IS NOT NULL) AS status FROM o GROUP BY k)
    SELECT c_custkey, coalesce(l.price, c_acctbal) AS c_acctbal, coalesce(l.status, c_mktsegment) AS tag FROM customer LEFT JOIN l ON k = c_custkey""",
)
def _(t):
    """Several partial changes of an id, made in the order of their dates; one attribute is a map."""
    from quakeframe.sources.tables import updated

    o = t("orders").join(t("customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    tag = lambda c: F.create_map(F.lit("tag"), F.col(c))
    changes = o.select(
        F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderkey", F.expr("CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS c_acctbal"),
        F.when(F.expr("o_orderkey % 2 = 0"), tag("o_orderstatus")).alias("tags"),
    )
    known = t("customer").select("c_custkey", "c_acctbal", tag("c_mktsegment").alias("tags"))
    return updated(known, changes, "c_custkey", order=["o_orderdate", "o_orderkey"]).select("c_custkey", "c_acctbal", F.col("tags")["tag"].alias("tag"))


@query(
    "spectra_verified",
    "SELECT vec_id, vec_id % 5 <> 0 AND label <> 2 AS live FROM embeddings",
)
def _(t):
    from quakeframe.sources.spectra import verified

    v = t("embeddings").select("vec_id", F.when(F.col("label") == 2, 0.0).otherwise(0.25).alias("df"), F.col("embedding").cast("array<double>").alias("spectrum"))
    return verified(v.withColumn("nf", F.when(F.col("vec_id") % 5 == 0, 63).otherwise(64))).select("vec_id", "live")


@query(
    "arrival_snr_saved",
    """SELECT o_orderkey AS arrival_id, round(max(l_quantity), 6) AS snr, round(coalesce(arg_max(l_extendedprice, (l_quantity, l_extendedprice)), o_totalprice), 6) AS time
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' GROUP BY o_orderkey, o_totalprice""",
)
def _(t):
    from quakeframe.sources.spectra import save_arrival_snr

    arrivals = t("orders").select(F.col("o_orderkey").alias("arrival_id"), F.col("o_totalprice").alias("time"))
    metrics = t("lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("arrival_id"), F.col("l_quantity").alias("snr_median"), F.col("l_extendedprice").alias("time"))
    out = save_arrival_snr(arrivals, metrics, use_measured_time=True)
    return out.select("arrival_id", F.round("Parrival.snr_median", 6).alias("snr"), F.round("time", 6).alias("time"))


@query("station_map", "SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'X' || user_id ELSE 'U' || user_id END AS sta, CASE WHEN user_id % 2 = 0 THEN 'NN' END AS net FROM events")
def _(t):
    from quakeframe.operators.group import set_network_from_map
    from quakeframe.plans.registry import packets

    known = t("events").filter("user_id % 2 = 0").select(F.expr("'U' || user_id AS css30_sta"), F.lit("NN").alias("net"), F.expr("'X' || user_id AS sta")).distinct()
    rows = packets(t).withColumn("net", F.lit(None).cast("string"))
    return set_network_from_map(rows, known)[0].select("event_id", "sta", "net")


@query("documents_round_trip", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS o_orderstatus, o_totalprice FROM orders")
def _(t):
    df = t("orders").select("o_orderkey", F.expr("nullif(o_orderstatus, 'F') AS o_orderstatus"), "o_totalprice", F.array(F.lit(1.0)).alias("data"))
    return tables.from_documents(tables.as_documents(df), "o_orderkey long, o_orderstatus string, o_totalprice double")


@query("saved_by_jobs", "SELECT vec_id, label, CASE WHEN label = 3 THEN 'dead' ELSE 'live' END AS place FROM embeddings")
def _(t):
    """Two jobs save their labels, one of them twice; every row is found once."""
    from quakeframe.operators.edit import MetadataEQ
    from quakeframe.runtime import shared_folder

    spark = t("embeddings").sparkSession
    root = shared_folder(spark, "saved")
    rows = MetadataEQ("label", 3).apply(t("embeddings").select("vec_id", "label", F.col("embedding").alias("data")))
    for job, part in (("low", "label < 5"), ("high", "label >= 5"), ("low", "label < 5")):
        tables.write_data(rows.filter(part), f"{root}/wf", f"{root}/cemetery", job=job)
    live = tables.read_table(spark, f"{root}/wf", "all").select("vec_id", "label", F.lit("live").alias("place"))
    stone = spark.read.parquet(f"{root}/cemetery").select(F.from_json("tombstone", "vec_id long, label int").alias("s"))
    return live.unionByName(stone.select("s.vec_id", "s.label", F.lit("dead").alias("place")))


@query(
    "spectra_saved",
    "SELECT vec_id, label, 64::BIGINT AS nf, round(list_sum([x::DOUBLE FOR x IN embedding]), 6) AS total FROM embeddings WHERE label <> 2 AND label >= 1",
)
def _(t):
    from quakeframe.runtime import shared_folder
    from quakeframe.sources.spectra import read_spectra, save_spectra

    spark = t("embeddings").sparkSession
    path = shared_folder(spark, "spectra")
    v = t("embeddings").select("vec_id", "label", F.lit(0.0).alias("f0"), F.when(F.col("label") == 2, 0.0).otherwise(0.25).alias("df"), F.lit(64).alias("nf"), F.lit("power").alias("spectrum_type"), F.col("embedding").cast("array<double>").alias("spectrum"))
    save_spectra(v, path, "raw")
    out = read_spectra(spark, path, "raw", {"label": {"$gte": 1}})
    return out.select("vec_id", "label", "nf", F.round(F.aggregate("spectrum", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))
