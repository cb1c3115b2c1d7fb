"""Readers, writers, history, streaming, and edges that the queries do not reach."""

import pytest
from pyspark.sql import functions as F

from quakeframe import history
from quakeframe.functions import arrays
from quakeframe.functions.kernels import Fatal, map_records
from quakeframe.operators import edit, group, match, undertaker
from quakeframe.schema import Attribute, database_schema, table_schema
from quakeframe.sources import tables, text
from quakeframe.state import kill_if, log_entry, with_state
from quakeframe.streaming import windows


def test_state_and_logs(spark):
    df = with_state(spark.range(3))
    out = kill_if(df, F.col("id") == 1, "t", "one")
    out = kill_if(out, F.col("id") == 1, "t", "again")
    row = out.filter("id = 1").first()
    assert not row.live and [e.message for e in row.elog] == ["one"]
    with pytest.raises(ValueError):
        log_entry("a", "b", "Bad")


def test_write_read_and_bury(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0])], "k long, data array<double>")
    dead = edit.MetadataEQ("k", 2).apply(df)
    tables.write_data(dead, str(tmp_path / "wf"), str(tmp_path / "cemetery"), data_tag="raw", id_keys=["k"])
    back = tables.read_table(spark, str(tmp_path / "wf"), "raw")
    assert [r.k for r in back.collect()] == [1] and len(back.first()._id) == 24 and back.columns[-2:] == ["data", "data_tag"]
    grave = spark.read.parquet(str(tmp_path / "cemetery")).first()
    assert '"k":2' in grave.tombstone and grave.logdata[0].message == "k eq 2"
    plan = tables.read_table(spark, str(tmp_path / "wf"), "raw").select("k")._jdf.queryExecution().toString()
    assert "data_tag" in plan and "ReadSchema: struct<k:bigint>" in plan
    assert [r.k for r in undertaker.mummify(dead).filter(F.size("data") == 0).collect()] == [2]


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("sta,net,n\nX,AA,1\nX,AA,1\nY,-,2\n")
    df = text.read_delimited(spark, str(tmp_path / "a.csv"), types={"n": "long"}, nulls={"net": "-"}, rename={"n": "count"}, constants={"tag": 1})
    assert sorted(map(tuple, df.collect()), key=str) == [("X", "AA", 1, 1), ("Y", None, 2, 1)]
    (tmp_path / "w.txt").write_text("  1  2.5  P\n\n 2   -1   S\n")
    df = text.read_whitespace_table(spark, str(tmp_path / "w.txt"), ["i", "x", "phase"], types={"i": "long", "x": "double"}, nulls={"x": -1.0})
    assert sorted(map(tuple, df.collect())) == [(1, 2.5, "P"), (2, None, "S")]
    layout = text.parse_layout("sta 6 0 string -\ntime 10 7 float -99.0\nid 4 18 int -1")
    rows = spark.createDataFrame([("ABC", 1.5, 7), ("D", None, None)], "sta string, time double, id long")
    text.fixed_width_lines(rows, layout).write.text(str(tmp_path / "fixed"))
    back = text.read_fixed_width(spark, str(tmp_path / "fixed"), layout)
    assert sorted(map(tuple, back.collect())) == [("ABC", 1.5, 7), ("D", None, None)]
    assert [r.id for r in text.read_fixed_width(spark, str(tmp_path / "fixed"), layout, keep_nulls=True).collect()].count(-1) == 1
    pf = text.parse_parameters("a 1\nb 2.5 # c\nt &Tbl{\nx y z\nq\n}\ns &Arr{\nk true\nn &Arr{\nm text\n}\n}\n")
    assert pf == {"a": 1, "b": 2.5, "t": ["x y z", "q"], "s": {"k": True, "n": {"m": "text"}}}


def test_waveform_rows(spark):
    rows = spark.createDataFrame([("114", "BHZ_00", "sd"), ("B", "BHE", "S1"), ("C", "BHN", "xx")], "sta string, chan string, datatype string")
    stations = spark.createDataFrame([("X0", "114", "S114")], "snet string, fsta string, sta string")
    got = sorted(map(tuple, text.waveform_rows(rows, stations, "TA").select("net", "sta", "chan", "loc").collect()))
    assert got == [("TA", "B", "BHE", None), ("X0", "S114", "BHZ", "00")]


def test_network_map(spark):
    rows = spark.createDataFrame([(1, "a", None, None), (2, "b", "N", None), (3, "c", None, None)], "i long, sta string, net string, css30_sta string")
    known = spark.createDataFrame([("a", "XX", "AAA")], "css30_sta string, net string, sta string")
    out, counts = group.set_network_from_map(rows, known)
    got = {r.i: (r.sta, r.net, r.css30_sta) for r in out.collect()}
    assert got == {1: ("AAA", "XX", "a"), 2: ("b", "N", "b"), 3: ("c", None, None)}
    assert tuple(counts.first()) == (3, 2, 1)


def test_inventory(spark):
    inv = spark.sql(
        """SELECT 'TA' AS code, array(named_struct('code', '035A', 'channels', array(
        named_struct('chan', 'BHZ', 'loc', '', 'lat', 1.0, 'lon', 2.0, 'elev', 3.0, 'starttime', 0.0D, 'endtime', 10.0D),
        named_struct('chan', 'BHN', 'loc', '', 'lat', 1.0, 'lon', 2.0, 'elev', 3.0, 'starttime', 5.0D, 'endtime', 20.0D)))) AS stations"""
    )
    site, channel = tables.flatten_inventory(inv)
    assert channel.count() == 2 and tuple(site.select("net", "sta", "starttime", "endtime").first()) == ("TA", "035A", 0.0, 20.0)


def test_schemas():
    s = database_schema({"site": {"schema": {"_id": {"type": "ObjectID"}, "lat": {"type": "double", "aliases": ["latitude"]}}}, "channel": {"base": "site", "schema": {"chan": {"type": "str", "constraint": "required", "readonly": True}}}})
    c = s["channel"]
    assert c.required_keys() == ["chan"] and c.unique_name("latitude") == "lat" and c.is_alias("latitude") and c.readonly("chan")
    assert c.struct()["lat"].metadata["aliases"] == ["latitude"] and c.type("lat") == "double"
    c.add_alias("chan", "channel")
    assert c.unique_name("channel") == "chan"
    with pytest.raises(KeyError):
        c.unique_name("nothing")
    with pytest.raises(ValueError):
        Attribute("x", "complex")


def test_kernel_errors_kill_and_fatal_ones_raise(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, None), (3, [0.0])], "i long, data array<double>")

    def inverse(x):
        if x[0] == 0:
            raise ZeroDivisionError("no inverse")
        return {"data": 1 / x}

    rows = {r.i: r for r in map_records(df, inverse, ["data"], {"data": "array<double>"}).collect()}
    assert rows[1].live and rows[1].data == [1.0]
    assert not rows[2].live and rows[2].elog[0].message == "missing data"
    assert not rows[3].live and rows[3].data == [0.0]

    def fatal(x):
        raise Fatal("stop")

    with pytest.raises(Exception, match="stop"):
        map_records(df.filter("i = 1"), fatal, ["data"], {"y": "double"}).collect()


def test_history(spark):
    df = history.stage(history.stage(spark.range(1), "read"), "filter", "1-2")
    h = df.first().history
    assert [(x.stage, x.algorithm) for x in h] == [(1, "read"), (2, "filter")] and h[0].alg_id != h[1].alg_id
    assert history.parameter_tree({"a": {"b": 1, "c": {"d": "x"}}, "e": 2}) == {"a.b": "1", "a.c.d": "x", "e": "2"}


def test_history_renamed(spark):
    log = spark.createDataFrame([("a", "1", "x"), ("b", "2", "y")], "alg_name string, parameters string, alg_id string")
    assert [tuple(r) for r in history.renamed(log, "x", "c", "3").collect()] == [("c", "3", "x"), ("b", "2", "y")]
    with pytest.raises(ValueError):
        history.renamed(log, "z", "c", "3")


def test_swapped_reference():
    wf = table_schema("wf", {"source_id": {"reference": "source", "aliases": ["sid"]}, "site_lat": {"type": "float", "reference": "site"}, "npts": {"type": "int"}})
    event = {"event": table_schema("event", {"source_id": {"type": "int", "constraint": "xref_key"}})}
    wf.swap_reference("source", "event", event)
    a = wf.attributes["source_id"]
    assert (a.reference, a.type, a.constraint, a.aliases) == ("event", "int", "xref_key", ("sid",))
    wf.swap_reference("nowhere", "event")
    assert wf.reference("site_lat") == "site" and wf.reference("npts") == "wf"


def test_band_join_is_no_nested_loop(spark):
    left = spark.range(100).select((F.col("id") * 7.0).alias("starttime"), "id")
    right = spark.range(50).select((F.col("id") * 13.0).alias("time"), F.col("id").alias("_id"))
    found = match.OriginTimeMatcher(right, "source", ["_id"], ["_id"], 5.0).find(left)
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    want = {(i, j) for i in range(100) for j in range(50) if abs(i * 7.0 - j * 13.0) <= 5}
    assert {(r.id, r.source_id) for r in found.collect()} == want


def test_empty_arrays(spark):
    df = spark.createDataFrame([([],), ([2.0],)], "d array<double>")
    rows = df.select(arrays.peak("d"), arrays.rms("d"), arrays.perc("d", 0.9), arrays.mad("d")).collect()
    assert [tuple(r) for r in rows] == [(0.0, 0.0, 0.0, 0.0), (2.0, 2.0, 2.0, 2.0)]


def test_free_surface_matrix_inverts_the_forward_response(spark):
    p, vp, vs = 0.06, 6.0, 3.5
    qa, qb = (1 / vp**2 - p * p) ** 0.5, (1 / vs**2 - p * p) ** 0.5
    m = arrays.free_surface_matrix(F.lit(p), F.lit(0.0), F.lit(vp), F.lit(vs))
    row = spark.range(1).select(F.array(*[F.array(*r) for r in m]).alias("m")).first().m
    # radial and vertical motion of a pure P wave at the free surface, up to scale: no SV remains
    z, r = qa * (1 / vs**2 - 2 * p * p), 2 * p * qa * qb
    sv = row[1][0] * r + row[1][2] * z
    pw = row[2][0] * r + row[2][2] * z
    assert abs(sv) < 1e-12 * abs(pw) + 1e-15 and row[0][1] == 0.5


def test_streams_agree_with_batches(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.coalesce(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))

    def drained(df, name):
        q = df.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    got = drained(windows.chunked(stream, "ts", ["event_type"], "1 day"), "chunks")
    last = batch.agg(F.max("ts")).first()[0]
    want = windows.chunked(batch, "ts", ["event_type"], "1 day").filter(F.col("end") <= F.lit(last) - F.expr("INTERVAL 10 MINUTES"))
    assert sorted(map(str, got.select("event_type", "start", "n").collect())) == sorted(map(str, want.select("event_type", "start", "n").collect()))
    once = drained(windows.without_repeats(stream.union(stream), "ts", ["event_id"]), "once")
    assert once.count() == batch.count()


def test_reduce_groups(spark):
    from quakeframe.functions.kernels import common_sum, reduce_groups

    df = spark.createDataFrame([("a", 1, [1.0, 2.0]), ("a", 2, [3.0, 4.0]), ("b", 1, [1.0])], "k string, i int, data array<double>")
    rows = {r.k: r for r in reduce_groups(df, common_sum, ["k"], ["i"]).collect()}
    assert rows["a"].data == [4.0, 6.0] and rows["a"].n_members == 2 and rows["b"].data == [1.0]

    def broken(a, b):
        raise ValueError("no")

    rows = {r.k: r for r in reduce_groups(df, broken, ["k"], ["i"]).collect()}
    assert not rows["a"].live and rows["a"].elog[0].message == "no" and rows["b"].live

    more = [(None, 2, [5.0]), (None, 1, [7.0]), ("c", 1, None), ("c", 2, [1.0]), ("d", None, [2.0]), ("d", 4, [3.0])] + [("hot", i, [float(i)]) for i in range(25000)]
    wide = df.unionByName(spark.createDataFrame(more, df.schema))

    def last(a, b):
        return b

    rows = {r.k: r for r in reduce_groups(wide, last, ["k"], ["i"]).collect()}
    assert rows[None].data == [5.0] and rows["d"].data == [2.0] and rows["hot"].data == [24999.0] and rows["hot"].n_members == 25000
    assert not rows["c"].live and rows["c"].n_members == 2 and rows["c"].elog[0].message == "missing data"
    assert reduce_groups(wide.limit(0), last, ["k"], ["i"]).count() == 0


def test_cells_of_intervals_meet_their_times_once(spark):
    import random

    from quakeframe.operators.intervals import interval_cells, point_cells

    rng = random.Random(5)
    spans = [(a := rng.uniform(-1e5, 1e9), a + rng.choice([0.0, 0.4, 3.0, 900.0, 1e6, 3e8, -5.0])) for _ in range(150)]
    spans += [(-1e300, 1e300), (0.0, float("inf")), (5.0, 5.0), (None, 1.0), (1.0, None), (16.0**7, 16.0**7 * 2)]
    times = [t for a, z in spans for x in (a, z) if x is not None and abs(x) < 1e17 for t in (x, x - 1, x + 1, x - 1e-6)] + [None]
    for unit in (1.0, 60.0):
        cells = spark.createDataFrame(list(enumerate(spans)), "i int, s struct<a:double,z:double>").select("i", interval_cells(F.col("s.a"), F.col("s.z"), unit).alias("c")).collect()
        points = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i int, t double").select("i", point_cells(F.col("t"), unit).alias("c")).collect()
        assert max(len(set(r.c)) for r in cells) == max(len(r.c) for r in cells) <= 30 * 7 + 512
        for c in cells:
            a, z = spans[c.i]
            for p in points:
                t = times[p.i]
                shared = len(set(c.c) & set(p.c))
                assert shared <= 1 and not (t is not None and a is not None and z is not None and a <= t <= z and shared == 0)


def test_updates_need_an_order(spark):
    df = spark.createDataFrame([(1, 1, {"a": "b"}), (2, 2, None)], "_id int, x int, m map<string,string>")
    changes = spark.createDataFrame([(1, 5, None, 1), (1, 3, {"c": "d"}, 2), (3, 9, None, 1), (None, 4, None, 1)], "_id int, x int, m map<string,string>, at int")
    got = {r._id: (r.x, r.m) for r in tables.updated(df, changes, order=["at"]).collect()}
    assert got == {1: (3, {"c": "d"}), 2: (2, None), 3: (9, None)}
    with pytest.raises(Exception, match="need an order"):
        tables.updated(df, changes.drop("at")).collect()
    apart = spark.createDataFrame([(1, 5, None), (1, None, {"c": "d"})], "_id int, x int, m map<string,string>")
    assert {r._id: (r.x, r.m) for r in tables.updated(df, apart).collect()}[1] == (5, {"c": "d"})


def test_normalizers_by_name(spark):
    site = spark.createDataFrame([("s1", 1.0, 2.0)], "_id string, lat double, lon double")
    other = spark.createDataFrame([("s1", 5)], "_id string, n int")
    rows = spark.createDataFrame([(1, "s1", "s1"), (2, "s2", "s1"), (3, None, None)], "k int, site_id string, extra_id string")
    own = match.normalizers(["site", "extra"], {"site": site, "extra": other})
    got = {r.k: (r.site_lat, r.extra_n, r.live) for r in match.normalize_all(rows, own).collect()}
    assert got == {1: (1.0, 5, True), 2: (None, None, False), 3: (None, None, False)}
    one, two = match.EqualityMatcher(site, "a", {"site_id": "_id"}, ["lat"], ["_id"]), match.EqualityMatcher(site.unionByName(site), "b", {"site_id": "_id"}, ["lon"], ["lat"])
    want = two.normalize(one.normalize(rows).drop("n_matches")).drop("n_matches")
    assert sorted(map(str, match.normalize_all(rows, [one, two]).select(*want.columns).collect())) == sorted(map(str, want.collect()))
    for wrong, error in ((["none"], ValueError), ([3], TypeError)):
        with pytest.raises(error):
            match.normalizers(wrong, {"site": site})


def test_histories_and_cycles(spark):
    edges = spark.createDataFrame([(None, "a"), ("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "d"), ("x", "d"), ("a", "b")], "parent string, child string")
    graph = history.edges(edges, "parent", "child", "stack")
    reached = history.ancestors(graph)
    assert sorted(map(tuple, reached.collect())) == [("b", "a"), ("c", "a"), ("d", "a"), ("d", "b"), ("d", "c"), ("d", "x")]
    assert sorted(map(tuple, history.origins(graph, reached.filter("id = 'd'")).collect())) == [("d", "a"), ("d", "x")]
    chain = history.group_edges(spark.range(1, 40).select(F.col("id").alias("m"), (F.col("id") + 1).alias("k")), ["k"], "m", F.col("k"), "step")
    assert history.ancestors(chain, spark.createDataFrame([(40,)], "id long")).count() == 39
    loop = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "parent int, child int").selectExpr("parent", "child")
    with pytest.raises(ValueError):
        history.ancestors(loop, rounds=6)


def test_as_of_edges(spark):
    from quakeframe.operators.asof import as_of

    left = spark.createDataFrame([(1, "a", 10.0), (2, "a", 1e6), (3, "b", 10.0), (4, None, 10.0), (5, "a", None), (6, "a", 10.0), (7, "a", -1e6)], "i int, k string, t double")
    right = spark.createDataFrame([("a", 8.0, 1), ("a", 12.0, 2), ("a", 12.0, 0), ("c", 10.0, 3), ("a", None, 4), (None, 10.0, 5)], "k string, s double, v int")
    for direction, want in (("backward", {1: 1, 2: 0, 6: 1}), ("forward", {1: 0, 6: 0, 7: 1}), ("nearest", {1: 1, 2: 0, 6: 1, 7: 1})):
        got = {r.i: r.asof_v for r in as_of(left, right, "t", "s", ["v"], ["k"], direction, order=["v"]).collect()}
        assert got == {i: want.get(i) for i in range(1, 8)}
    assert {r.i for r in as_of(left, right, "t", "s", ["v"], ["k"], tolerance=2.0, order=["v"]).filter("asof_v IS NOT NULL").collect()} == {1, 6}
    assert as_of(left, right.limit(0), "t", "s", ["v"], ["k"]).filter("asof_v IS NULL").count() == 7


def test_travel_times_and_arcs(spark):
    from quakeframe.sources.hypocentres import TravelTimes, arc

    table = TravelTimes(0.0, 10.0, 0.0, 100.0, [[0.0, 100.0, 150.0], [10.0, 90.0, 170.0]])
    rows = spark.createDataFrame([(0.0, 0.0), (5.0, 50.0), (20.0, 100.0), (21.0, 0.0), (-1.0, 0.0), (5.0, 101.0), (None, 0.0)], "d double, z double")
    got = [r[0] for r in rows.select(table.at(F.col("d"), F.col("z"))).collect()]
    assert got == [0.0, 50.0, 170.0, None, None, None, None]
    assert spark.range(1).select(arc(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0))).first()[0] == pytest.approx(90.0)


def test_spectra_round_trip(spark, tmp_path):
    from quakeframe.sources import spectra

    df = spark.createDataFrame([(1, 0.5, [1.0, 2.0, 3.0]), (2, 0.25, [4.0])], "i int, df double, spectrum array<double>").withColumns({"nf": F.size("spectrum"), "f0": F.lit(0.0), "spectrum_type": F.lit("power")})
    spectra.save_spectra(df, str(tmp_path / "s"))
    back = spectra.read_spectra(spark, str(tmp_path / "s"))
    assert {r.i: r.spectrum for r in back.collect()} == {1: [1.0, 2.0, 3.0], 2: [4.0]}


def test_check_format():
    from quakeframe.schema import check_format

    good = {"wf": {"schema": {"_id": {"type": "string", "constraint": "required"}, "site_id": {"reference": "site", "aliases": ["sid"]}}}, "site": {"schema": {"lat": {"type": "double"}}}, "wf2": {"base": "wf", "schema": {}}}
    assert check_format(good) == []
    bad = {"a": {"base": "b", "schema": {"x": {"type": "cube"}, "y": {"constraint": "never", "reference": "z", "aliases": ["x"]}, "q": 3}}, "b": {"base": "a"}, "c": 1, "d": {"base": "e", "schema": {"k": {"aliases": "m"}}}}
    found = check_format(bad)
    assert len(found) == 10 and all(any(w in f for f in found) for w in ("cube", "never", "reference z", "names x", "a.q", "leads back", "c: no", "base e", "aliases are"))


def test_bandwidth(spark):
    df = spark.createDataFrame([(1, "0.5", 2.0), (2, None, 2.0), (3, "3", 2.0), (4, "x", None)], "i int, lo string, hi double")
    rows = {r.i: (r.live, r.flow, r.fhigh, [e.message for e in r.elog]) for r in edit.validate_bandwidth(df, "lo", "hi").collect()}
    assert rows == {1: (True, 0.5, 2.0, []), 2: (False, -1.0, 2.0, ["no bandwidth under lo"]), 3: (False, 3.0, 2.0, ["invalid bandwidth: 3.0 to 2.0"]), 4: (False, -1.0, -1.0, ["no bandwidth under lo, hi"])}
    assert edit.fetch_bandwidth(df, "none", "hi").first().flow == -1.0


def test_documents(spark):
    df = spark.createDataFrame([(1, "a", [1.0]), (2, None, None)], "i int, s string, data array<double>")
    assert [r.document for r in tables.as_documents(df).collect()] == ['{"i":1,"s":"a"}', '{"i":2}']
    assert "\n" in tables.as_documents(df, pretty=True).first().document


def test_wide_values_are_not_cut(spark):
    columns = text.parse_layout("n 3 0 int -1\ns 4 4 string -")
    df = spark.createDataFrame([(999, "abcd"), (None, None)], "n long, s string")
    assert [r.value for r in text.fixed_width_lines(df, columns).collect()] == ["999 abcd", " -1 -"]
    for row in ((1000, "a"), (1, "abcde")):
        with pytest.raises(Exception, match="is wider than"):
            text.fixed_width_lines(spark.createDataFrame([row], "n long, s string"), columns).collect()


def test_nan_is_above_all_numbers(spark):
    df = spark.createDataFrame([(float("nan"),)], "x double")
    assert [edit.Compare("x", 1e300, r).apply(df).first().live for r in ("gt", "ge", "lt", "le", "eq", "ne")] == [False, False, True, True, True, False]


def test_lookups_in_time_broadcast_nothing(spark):
    """Sizes guessed from compressed files would let the driver hold whole tables."""
    from quakeframe.plans.catalogue import QUERIES

    plan = QUERIES["hypocenters_by_time"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan


def test_nearest_origins_make_no_pairs(spark):
    """As many sources in the band as one likes: neighbours in time and running counts decide, ties by the order."""
    left = spark.range(60).select("id", F.expr("CASE WHEN id = 7 THEN NULL WHEN id = 8 THEN double('NaN') ELSE 1.7e9 + (id % 50) * 0.5 END AS starttime"))
    right = spark.range(90).select((1.7e9 + F.expr("(id * 37 % 41) * 0.75 - 8")).alias("time"), (100 - F.col("id")).alias("_id"))
    own = match.OriginTimeMatcher(right, "source", ["_id"], ["_id"], 2.5, 1.25)
    found = own.find_one(left)
    assert "Generate explode(array(" not in found._jdf.queryExecution().optimizedPlan().toString()
    table, got = right.collect(), {r.id: (r.source_id, r.n_matches) for r in found.collect()}
    assert len(got) == 60
    for r in left.collect():
        hits = sorted((abs(s.time - (r.starttime - 1.25)), s._id) for s in table if r.starttime is not None and abs(s.time - (r.starttime - 1.25)) <= 2.5)
        assert got[r.id] == ((hits[0][1], len(hits)) if hits else (None, 0))


@pytest.mark.parametrize("most", [3, 8192])
@pytest.mark.parametrize("tolerance", [0.0, 2.5])
def test_origins_in_a_band_are_dealt_evenly(spark, monkeypatch, most, tolerance):
    """One place of many rows is not one task, few bytes are not few tasks, and a task holds few of the table; every pair comes once."""
    monkeypatch.setattr(match.OriginTimeMatcher, "ROWS", most, raising=False)
    odd = "WHEN id % 17 = 0 THEN NULL WHEN id % 19 = 0 THEN double('NaN') WHEN id % 23 = 0 THEN double('inf') WHEN id % 29 = 0 THEN -1e300"
    left = spark.range(120).selectExpr("id", "array(id) AS data", f"CASE {odd} WHEN id % 5 = 0 THEN id * 0.25 - 9 ELSE 50 END AS starttime").union(spark.sql("SELECT 1L, array(1L), 50D"))
    right = spark.range(150).selectExpr(f"CASE {odd} WHEN id % 3 = 0 THEN id * 0.25 - 9 ELSE 48.75 + id % 3 END AS time", "IF(id = 8, NULL, id) AS _id", "id AS rank")
    table = right.collect()
    far = lambda s, r: s.time is None or r.starttime is None or not abs(s.time - (r.starttime - 1.25)) <= tolerance
    own = match.OriginTimeMatcher(right, "source", ["_id"], ["rank"], tolerance, 1.25, nearest=False)
    found, all_of = own.find(left), left.collect()
    want = sorted((r.id, s._id) for r in all_of for s in table if not far(s, r) and s._id is not None)
    assert want and sorted((r.id, r.source_id) for r in found.collect()) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "SortMergeJoin" in plan
    if most == 3:
        sizes = [r.n for r in found.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert max(sizes) < len(want) / 2
    first = {(r.id, r.source_id, r.n_matches) for r in own.find_one(left).collect()}
    hits = lambda r: [s._id for s in table if not far(s, r) and s._id is not None]
    assert first == {(r.id, min(hits(r), default=None), len(hits(r))) for r in all_of}


@pytest.mark.parametrize("spans", [False, True])
def test_epochs_meet_times_without_cells(spark, spans):
    """Overlapping, touching, endless and reversed epochs, by an order that is not that of their starts."""
    site = spark.range(60).selectExpr("IF(id % 4 = 0, 'S', 'T') AS sta", "id AS _id", "double(id * 37 % 59) AS starttime", "CASE WHEN id % 11 = 0 THEN double('NaN') WHEN id % 13 = 0 THEN NULL ELSE double(id * 37 % 59 + id * 7 % 9 - 1) END AS endtime", "-id AS rank")
    rows = spark.range(140).selectExpr("id", "CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'S' WHEN 2 THEN 'U' ELSE 'T' END AS sta", "IF(id = 9, NULL, id * 0.5D - 2) AS time", "id * 0.5D - 2 + id % 3 AS endtime")
    own = (match.MiniseedDBMatcher if spans else match.MiniseedMatcher)(site, "site", ["sta"], ["_id"], ["rank"], time="time")
    found = own.find_one(rows, ["id"])
    if not spans:
        assert "explode" not in found._jdf.queryExecution().optimizedPlan().toString()
    table, got = site.collect(), {r.id: (r.site_id, r.n_matches) for r in found.collect()}
    assert len(got) == 140
    for r in rows.collect():
        last = r.endtime if spans else r.time
        far = lambda s: float("inf") if s.endtime != s.endtime else s.endtime
        hits = [(s.rank, s._id) for s in table if r.time is not None and s.sta == r.sta and s.endtime is not None and s.starttime <= r.time and last <= far(s)]
        assert got[r.id] == ((min(hits)[1], len(hits)) if hits else (None, 0))


@pytest.mark.parametrize("order", ["IF(id % 7 = 0, DOUBLE('NaN'), -id)", "STRING(id * 31 % 41)", "timestamp_seconds(-id)", "ARRAY(id % 3, -id)", "DECIMAL(id * 17 % 41)"])
def test_first_epochs_by_orders_of_any_type_without_numbers(spark, order):
    site = spark.range(40).selectExpr("'S' AS sta", "id AS _id", "DOUBLE(id * 37 % 59) AS starttime", "DOUBLE(id * 37 % 59 + 9) AS endtime", f"{order} AS ord")
    rows = spark.range(80).selectExpr("id", "'S' AS sta", "DOUBLE(id) AS time")
    found = match.MiniseedMatcher(site, "site", ["sta"], ["_id"], ["ord", "_id"], time="time").find_one(rows)
    assert "row_number" not in found._jdf.queryExecution().optimizedPlan().toString()
    met = rows.join(site.withColumnRenamed("sta", "s"), F.expr("time BETWEEN starttime AND endtime"), "left").groupBy("id").agg(F.min_by("_id", F.struct("ord", "_id")).alias("first"), F.count("_id").alias("n"))
    assert sorted(map(tuple, found.select("id", "site_id", "n_matches").collect()), key=str) == sorted(map(tuple, met.collect()), key=str)


def test_ancestors_are_dealt_by_what_they_prolong_to(spark, monkeypatch):
    dealt, deal = [], history._dealt
    monkeypatch.setattr(history, "ROWS", 20)
    monkeypatch.setattr(history, "_dealt", lambda *a: dealt.append(deal(*a).rdd.getNumPartitions()) or deal(*a))
    chain = history.edges(spark.range(1, 40).selectExpr("id AS m", "id + 1 AS k"), "m", "k", "step")
    found = history.ancestors(chain)
    assert found.count() == 39 * 40 // 2 and max(dealt) >= 16  # 4 cores; more partitions as rows come


def descent(edges):
    """All (id, ancestor), by following each edge."""
    made = {}
    for a, b in edges:
        made.setdefault(b, set()).add(a)
    found = set()
    for start in made:
        seen, open_ = set(), [start]
        while open_:
            new = made.get(open_.pop(), set()) - seen
            seen |= new
            open_ += new
        found |= {(start, a) for a in seen}
    return found


@pytest.mark.parametrize("text", [False, True])
def test_ancestors_in_batches_and_parts_are_whole(spark, monkeypatch, text):
    import numpy as np

    rng = np.random.default_rng(4)
    name = (lambda k: f"k{k:03d}") if text else int
    pairs = [(name(a), name(b)) for b in range(1, 50) for a in rng.integers(max(0, b - 20), b, 2)] + [(name(a), name(200)) for a in range(40)]
    want, kind = descent(pairs), "parent string, child string" if text else "parent long, child long"
    graph = history.edges(spark.createDataFrame(pairs, kind), "parent", "child", "stack")
    sizes, make = [], history._written
    monkeypatch.setattr(history, "_written", lambda *a: sizes.append(make(*a)) or sizes[-1])
    for limits in ({"BATCH": 1000, "SOME": 10}, {"BATCH": 2000, "MEMBERS": 20, "PAIRS": 500, "BROADCAST_ROWS": 0}):
        for limit, most in limits.items():
            monkeypatch.setattr(history, limit, most)
        reached = history.ancestors(graph)
        assert reached.count() == len(want) and set(map(tuple, reached.collect())) == want
        if "MEMBERS" in limits:
            rows = sizes[-2].rows.selectExpr("id", "size(members) AS n").collect()
            assert sum(r.id == name(200) for r in rows) > 1 and max(r.n for r in rows) <= 40
        roots = {a for a, _ in pairs} - {b for _, b in pairs}
        assert sorted(map(tuple, history.origins(graph, reached).collect())) == sorted(p for p in want if p[1] in roots)
    some = history.ancestors(graph, spark.createDataFrame([(name(200),), (name(7),), (None,)], "id string" if text else "id long"))
    assert set(map(tuple, some.collect())) == {p for p in want if p[0] in (name(200), name(7))}


def test_finished_rounds_of_ancestors_leave_no_files(spark):
    import os
    import time
    from urllib.parse import urlparse

    shared = urlparse(spark.conf.get("spark.checkpoint.dir")).path
    kept = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    tables, files, key = set(os.listdir(shared)), kept(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, graph = spark.conf.get(key), spark.range(1, 300).selectExpr("id AS parent", "id + 1 AS child")
    reached = history.ancestors(graph)
    assert len(set(os.listdir(shared)) - tables) == 1 and spark.conf.get(key) == before
    until = time.time() + 20
    while kept() > files and time.time() < until:  # Spark deletes them in the background
        time.sleep(0.2)
    assert kept() <= files
    assert reached.count() == 299 * 300 // 2
