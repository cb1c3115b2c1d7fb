"""Killers and editors over the driver's tables."""

from pyspark.sql import functions as F

from quakeframe.operators import edit as e
from quakeframe.operators.undertaker import bring_out_your_dead, cemetery
from quakeframe.plans.registry import PACKETS, packets, query
from quakeframe.state import ELOG, LIVE, attribute, kill_if

for _name, _killer, _op in (("gt", e.MetadataGT, ">"), ("ge", e.MetadataGE, ">="), ("lt", e.MetadataLT, "<"), ("le", e.MetadataLE, "<="), ("eq", e.MetadataEQ, "="), ("ne", e.MetadataNE, "<>")):

    @query(f"kill_{_name}", f"SELECT event_id, NOT (user_id {_op} 50) AS live, CASE WHEN user_id {_op} 50 THEN 1 ELSE 0 END AS n_log FROM events")
    def _compare(t, killer=_killer):
        return killer("user_id", 50).apply(t("events")).select("event_id", LIVE, F.size(ELOG).alias("n_log"))


_part = "WITH p AS (SELECT p_partkey, p_brand, nullif(p_size, 7) AS p_size, p_retailprice, p_name FROM part) "


def part(t):
    return t("part").withColumn("p_size", F.expr("nullif(p_size, 7)"))


@query("kill_defined", _part + "SELECT p_partkey, p_size IS NULL AS live FROM p")
def _(t):
    return e.MetadataDefined("p_size").apply(part(t)).select("p_partkey", LIVE)


@query("kill_undefined", _part + "SELECT p_partkey, p_size IS NOT NULL AS live FROM p")
def _(t):
    return e.MetadataUndefined("p_size").apply(part(t)).select("p_partkey", LIVE)


@query("kill_missing_ignored", _part + "SELECT p_partkey, NOT coalesce(p_size > 10, false) AS live FROM p")
def _(t):
    return e.MetadataGT("p_size", 10).apply(part(t)).select("p_partkey", LIVE)


@query("kill_interval_outside", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_quantity BETWEEN 10 AND 40 AS live FROM lineitem")
def _(t):
    return e.MetadataInterval("l_quantity", 10.0, 40.0).apply(t("lineitem")).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", LIVE)


@query("kill_interval_inside_open", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, NOT (l_quantity > 10 AND l_quantity < 40) AS live FROM lineitem")
def _(t):
    k = e.MetadataInterval("l_quantity", 10.0, 40.0, False, False, kill_if_outside=False)
    return k.apply(t("lineitem")).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", LIVE)


@query(
    "firing_squad_first_reason",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, NOT (l_discount > 0.08 OR l_quantity < 5 OR l_returnflag = 'R') AS live,
    CASE WHEN l_discount > 0.08 THEN 'l_discount gt 0.08' WHEN l_quantity < 5 THEN 'l_quantity lt 5' WHEN l_returnflag = 'R' THEN 'l_returnflag eq R' END AS reason FROM lineitem""",
)
def _(t):
    squad = e.FiringSquad([e.MetadataGT("l_discount", 0.08), e.MetadataLT("l_quantity", 5)])
    squad += e.MetadataEQ("l_returnflag", "R")
    out = squad.apply(t("lineitem"))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", LIVE, F.get(ELOG, F.lit(0))["message"].alias("reason"))


@query("change_key", _part + "SELECT p_partkey, p_size AS size_code, true AS live FROM p")
def _(t):
    return e.ChangeKey("p_size", "size_code").apply(part(t)).select("p_partkey", "size_code", LIVE)


@query("set_value", "SELECT p_partkey, CASE WHEN p_size > 25 THEN NULL ELSE 'small' END AS class, p_size <= 25 AS live FROM part")
def _(t):
    chain = e.MetadataOperatorChain([e.MetadataGT("p_size", 25), e.SetValue("class", "small")])
    return chain.apply(t("part")).select("p_partkey", "class", LIVE)


@query("erase_keys", "SELECT p_partkey, p_name, p_type FROM part")
def _(t):
    return e.erase_metadata(t("part"), ["p_brand", "p_size", "p_retailprice", "absent"]).select("p_partkey", "p_name", "p_type")


_keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]
for _name, _editor, _value, _sql in (
    ("add", e.Add, 2.5, "l_quantity + 2.5"),
    ("sub", e.Subtract, 30.0, "l_quantity - 30.0"),
    ("mul", e.Multiply, -1.5, "l_quantity * -1.5"),
    ("div", e.Divide, 4, "l_quantity / 4.0"),
    ("idiv", e.IntegerDivide, -7, "CAST(floor(l_quantity / -7.0) AS DOUBLE)"),
    ("mod", e.Mod, -7, "l_quantity - -7.0 * CAST(floor(l_quantity / -7.0) AS DOUBLE)"),
):

    @query(f"op_{_name}", f"SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, round(CAST({_sql} AS DOUBLE), 6) AS l_quantity, true AS live FROM lineitem")
    def _one(t, editor=_editor, value=_value):
        df = t("lineitem").withColumn("l_quantity", F.col("l_quantity").cast("double"))
        return editor("l_quantity", value).apply(df).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.round("l_quantity", 6).alias("l_quantity"), LIVE)


@query("op_div_zero", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, false AS live FROM lineitem")
def _(t):
    return e.Divide("l_quantity", 0).apply(t("lineitem")).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", LIVE)


# a divisor that is zero for some rows and missing for others
_two = "WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CAST(l_quantity AS DOUBLE) AS a, CAST(nullif(l_linenumber, 3) - 2 AS DOUBLE) AS b FROM lineitem) "
for _name, _editor, _sql in (
    ("add2", e.Add2, "a + b"),
    ("sub2", e.Subtract2, "a - b"),
    ("mul2", e.Multiply2, "a * b"),
    ("div2", e.Divide2, "CASE WHEN b <> 0 THEN a / b END"),
    ("idiv2", e.IntegerDivide2, "CASE WHEN b <> 0 THEN CAST(floor(a / b) AS DOUBLE) END"),
    ("mod2", e.Mod2, "CASE WHEN b <> 0 THEN a - b * CAST(floor(a / b) AS DOUBLE) END"),
):

    @query(f"op_{_name}", _two + f"SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, round({_sql}, 6) AS c, ({_sql}) IS NOT NULL AS live, CASE WHEN b IS NULL THEN 1 ELSE 0 END AS n_log FROM l")
    def _pair(t, editor=_editor):
        df = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.col("l_quantity").cast("double").alias("a"), F.expr("CAST(nullif(l_linenumber, 3) - 2 AS DOUBLE)").alias("b"))
        return editor("c", "a", "b").apply(df).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.round("c", 6).alias("c"), LIVE, F.size(ELOG).alias("n_log"))


@query("op_add_strings", "SELECT p_partkey, p_brand || '-x' AS p_brand, true AS live FROM part")
def _(t):
    return e.Add("p_brand", "-x").apply(t("part")).select("p_partkey", "p_brand", LIVE)


@query(
    "op_chain",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount > 0.02 AS live,
    CASE WHEN l_discount > 0.02 THEN round(l_extendedprice * (1 - l_discount), 4) END AS net FROM lineitem""",
)
def _(t):
    chain = e.MetadataOperatorChain([e.MetadataLE("l_discount", 0.02), e.SetValue("one", 1.0), e.Subtract2("share", "one", "l_discount"), e.Multiply2("net", "l_extendedprice", "share")])
    return chain.apply(t("lineitem")).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", LIVE, F.round("net", 4).alias("net"))


@query("janitor_clean", "SELECT c_custkey, c_name FROM customer")
def _(t):
    return e.Janitor(["c_custkey"]).add2keepers("c_name").clean(t("customer"))


@query("janitor_bag", "SELECT c_custkey, 2 AS n_bagged, c_mktsegment AS segment FROM customer")
def _(t):
    out = e.Janitor(["c_custkey", "c_name", "c_acctbal"]).bag_trash(t("customer"))
    return out.select("c_custkey", F.size("trash").alias("n_bagged"), F.col("trash")["c_mktsegment"].alias("segment"))


@query("geojson", "SELECT c_custkey, 'Point' AS kind, round(c_acctbal / 100, 4) AS lon FROM customer")
def _(t):
    p = e.geojson_point(F.lit(1.0), F.col("c_acctbal") / 100)
    return t("customer").select("c_custkey", p["type"].alias("kind"), F.round(p["coordinates"][0], 4).alias("lon"))


@query("bury_split", f"WITH {PACKETS} SELECT chan, count(*) FILTER (value <= 100) AS n_live, count(*) FILTER (value > 100) AS n_dead FROM p GROUP BY chan")
def _(t):
    live, dead = bring_out_your_dead(e.MetadataGT("value", 100).apply(packets(t)))
    both = live.select("chan", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(dead.select("chan", F.lit(0).alias("a"), F.lit(1).alias("b")))
    return both.groupBy("chan").agg(F.sum("a").alias("n_live"), F.sum("b").alias("n_dead"))


@query("cemetery_counts", f"WITH {PACKETS} SELECT 'value gt 100' AS message, count(*) AS n, sum(event_id)::BIGINT AS ids FROM p WHERE value > 100")
def _(t):
    dead = cemetery(e.MetadataGT("value", 100).apply(packets(t)))
    return dead.groupBy(F.element_at("logdata", 1)["message"].alias("message")).agg(F.count("*").alias("n"), F.sum(F.get_json_object("tombstone", "$.event_id").cast("long")).alias("ids"))


@query("edit_members", "SELECT label, count(*) AS n, sum(CASE WHEN label = 3 THEN NULL WHEN vec_id % 10 > 5 THEN 0 ELSE 1 END)::BIGINT AS alive FROM embeddings GROUP BY label")
def _(t):
    """A killer on the members of live ensembles; the dead ensemble stays as it is."""
    from quakeframe.operators import group

    rows = t("embeddings").select("label", "vec_id", (F.col("vec_id") % 10).cast("int").alias("q"))
    ensembles = group.fold(rows, ["label"], ["vec_id"]).withColumn(LIVE, F.col("label") != 3)
    killed = group.apply_to_members(ensembles, e.MetadataGT("q", 5).apply)
    alive = F.size(F.filter("members", lambda m: m[LIVE])).cast("long")
    return killed.select("label", F.size("members").cast("long").alias("n"), F.when(F.col(LIVE), alive).alias("alive"))


@query(
    "edit_members_repeated",
    """WITH m AS (SELECT label % 3 AS k, vec_id, (vec_id % 10)::INTEGER AS q FROM embeddings),
    e AS (SELECT k, unnest([1, 2]) AS twin, list(vec_id ORDER BY vec_id) AS ids, list(q ORDER BY vec_id) AS qs FROM m WHERE k <> 2 GROUP BY k
      UNION ALL SELECT NULL, 1, [], [])
    SELECT k, len([x FOR x IN qs IF x > 3])::BIGINT AS n, coalesce(list_sum([x FOR x IN qs IF x > 3]), 0)::BIGINT AS total,
      coalesce(list_sum([CASE WHEN x > 3 AND x % 2 = 1 THEN 1 ELSE 0 END FOR x IN qs]), 0)::BIGINT AS alive, coalesce(list_sum([x * 10 FOR x IN qs IF x > 3]), 0)::BIGINT AS tens FROM e""",
)
def _(t):
    """Ensembles that repeat, one with a null header and no members; a filter, a killer and arithmetic."""
    from quakeframe.operators import group

    rows = t("embeddings").select((F.col("label") % 3).alias("k"), "vec_id", (F.col("vec_id") % 10).cast("int").alias("q"))
    once = group.fold(rows, ["k"], ["vec_id"])
    empty = once.limit(1).select(F.lit(None).cast("int").alias("k"), F.slice("members", 1, 0).alias("members"))
    ensembles = once.filter("k <> 2").unionByName(once.filter("k <> 2")).unionByName(empty)
    out = group.apply_to_members(ensembles, [lambda m: m.filter(attribute("q") > 3), e.MetadataOperatorChain([e.Multiply2("ten", "q", "q"), e.SetValue("ten", 10), e.Multiply2("ten", "q", "ten")]), lambda m: kill_if(m, attribute("q") % 2 == 0, "even", "even")])
    total = lambda c: F.aggregate("members", F.lit(0).cast("long"), lambda a, m: a + c(m).cast("long"))
    return out.select("k", F.size("members").cast("long").alias("n"), total(lambda m: m["q"]).alias("total"), total(lambda m: m[LIVE]).alias("alive"), total(lambda m: m["ten"]).alias("tens"))


@query(
    "bandwidth_checked",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, coalesce(nullif(l_discount, 0), -1.0) AS flow, l_tax AS fhigh, l_discount <> 0 AND l_tax > l_discount AS live,
    CASE WHEN l_discount = 0 THEN 'no bandwidth under low' WHEN l_tax <= l_discount THEN 'invalid' END AS message FROM lineitem""",
)
def _(t):
    df = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.expr("nullif(l_discount, 0) AS low"), F.col("l_tax").alias("high"))
    out = e.validate_bandwidth(df, "low", "high")
    message = F.get(ELOG, F.lit(0))["message"]
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "flow", "fhigh", LIVE, F.when(message.startswith("invalid"), "invalid").otherwise(message).alias("message"))
