"""Binary records, lookups, interval reading, gathers and the command line."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quakeframe import cli
from quakeframe.functions import gather
from quakeframe.functions.array_decon import deconvolve_members
from quakeframe.functions.kernels import map_records
from quakeframe.operators import merging
from quakeframe.sources import lookup, miniseed
from quakeframe.state import kill_if


def steim_words(samples, version):
    """An encoder of one difference a word (32 bits in version 1, 30 in version 2)."""
    d = np.diff(np.r_[0, samples])
    words, code, extra = [], 3 if version == 1 else 2, 0 if version == 1 else 1 << 30
    queue, frame = list(d), 0
    while queue:
        slots = 13 if frame == 0 else 15
        part, queue = queue[:slots], queue[slots:]
        body = [samples[0] & 0xFFFFFFFF, samples[-1] & 0xFFFFFFFF] if frame == 0 else []
        first = len(body)
        mask = 0xFFFFFFFF if version == 1 else 0x3FFFFFFF
        body += [(int(v) & mask) | extra for v in part]
        control = sum(code << 2 * (15 - (k + 1)) for k in range(first, len(body)))
        words += [control, *body, *[0] * (15 - len(body))]
        frame += 1
    return np.array(words, np.uint32)


@pytest.mark.parametrize("version", [1, 2])
def test_steim(version):
    x = np.random.default_rng(version).integers(-(10**6), 10**6, 100)
    words = steim_words(x.tolist(), version)
    assert miniseed.steim(words, 100, version).tolist() == x.tolist()
    broken = words.copy()
    broken[5] ^= 1
    with pytest.raises(ValueError):
        miniseed.steim(broken, 100, version)


def test_steim_small_differences():
    x = np.cumsum([1, -2, 3, -4])
    word = sum((int(v) & 0xFF) << 8 * (3 - i) for i, v in enumerate([1, -2, 3, -4]))
    frame = [1 << 2 * 12, int(x[0]), int(x[-1]) & 0xFFFFFFFF, word] + [0] * 12
    assert miniseed.steim(np.array(frame, np.uint32), 4, 1).tolist() == x.tolist()


def test_files(spark, tmp_path):
    start = 1_700_000_000.0
    x = np.arange(1000)
    first = miniseed.write_records("TA", "035A", "", "BHZ", start, 20, x[:500])
    second = miniseed.write_records("TA", "035A", "", "BHZ", start + 30, 20, x[600:])  # 100 samples are missing
    (tmp_path / "a.mseed").write_bytes(first + second)
    (tmp_path / "b.mseed").write_bytes(miniseed.write_records("TA", "035A", "00", "BHE", start, 40, x) + b"junk")
    index = sorted(map(tuple, miniseed.index_files(spark, str(tmp_path)).select("loc", "chan", "npts", "foff", "nbytes", "npackets", F.round("starttime", 4)).collect()))
    assert index == [("", "BHZ", 400, len(first), len(second), 4, start + 30), ("", "BHZ", 500, 0, len(first), 5, start), ("00", "BHE", 1000, 0, 9 * 512, 9, start)]
    merged = merging.merge(miniseed.read_series(spark, str(tmp_path)), ["net", "sta", "loc", "chan"], zero_gaps=True)
    rows = {r.chan: r for r in merged.collect()}
    assert rows["BHE"].data == x.tolist() and rows["BHE"].live
    assert rows["BHZ"].has_gap and len(rows["BHZ"].data) == 1000 and rows["BHZ"].data[500:600] == [0.0] * 100


def test_header_fields():
    assert miniseed.nominal_rate(20, 1) == 20 and miniseed.nominal_rate(-10, 1) == pytest.approx(0.1)
    assert miniseed.nominal_rate(20, -2) == pytest.approx(10) and miniseed.nominal_rate(0, 1) == 0
    assert miniseed.record_header(b"short", 0) is None


def test_lookup_and_interval(spark):
    rows = [("a", "N", "S", "BHZ", None, 0.0, 10.0), ("b", "N", "S", "BHZ", "", 0.0, 10.0), ("c", "N", "S", "BHZ", "00", 0.0, 10.0), ("d", "N", "S", "BHZ", "00", 10.0, 20.0)]
    channel = spark.createDataFrame(rows, "_id string, net string, sta string, chan string, loc string, starttime double, endtime double")
    got = lookup.seed_channel(channel, "N", "S", "BHZ", time=5.0).first()
    assert (got["_id"], got.n_matches) == ("a", 3)
    assert lookup.seed_channel(channel, "N", "S", "BHZ", "00", 15.0).first()["_id"] == "d"
    assert lookup.seed_site(channel, "N", "S", time=10.0).count() == 0
    assert lookup.report(channel, sta="S").columns[-2:] == ["from", "to"]
    assert lookup.overlapping_epochs(channel).count() == 2
    series = spark.createDataFrame([("BHZ", None, "N", "S", 0.0, 1.0, [1.0] * 10), ("BHZ", None, "N", "S", 10.0, 1.0, [2.0] * 10), ("BHZ", None, "N", "T", 50.0, 1.0, [3.0])], "chan string, loc string, net string, sta string, t0 double, dt double, data array<double>")
    (ens,) = lookup.read_time_interval(series, 5.0, 14.0).collect()
    assert len(ens.members) == 1 and ens.members[0].data == [1.0] * 5 + [2.0] * 5 and ens.members[0].t0 == 5.0


def test_calibration(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 3.0), (2, [1.0], None)], "channel_id long, data array<double>, calib double")
    calibs = spark.createDataFrame([(1, 2.0)], "_id long, calib double")
    rows = {r.channel_id: r for r in lookup.apply_calib(df, calibs).collect()}
    assert rows[1].data == [2.0, 4.0] and rows[1].calib == 1.0 and not rows[2].live
    assert lookup.apply_calib(df, calibs, kill_if_undefined=False).filter("channel_id = 2").first().elog[0].badness == "Complaint"


def test_links_and_networks(spark):
    wf = spark.createDataFrame([(1, 100.0), (2, 200.0), (3, 999.0)], "k long, starttime double")
    src = spark.createDataFrame([("a", 95.0, None), ("b", 104.0, 7), ("c", 203.0, None), ("d", 205.0, None)], "_id string, time double, evid int")
    assert {r.k: r.source_id for r in lookup.link_sources(wf, src).collect()} == {1: "b", 2: "d", 3: None}
    assert {r.k: r.source_id for r in lookup.link_sources(wf, src, prefer_evid=True).collect()} == {1: "b", 2: "d", 3: None}
    arr = spark.createDataFrame([(1, "S", None, 5.0), (2, "T", "OLD", 5.0), (3, "U", None, 5.0)], "k long, sta string, net string, time double")
    site = spark.createDataFrame([("S", "A", 0.0, 10.0), ("T", "B", 0.0, 10.0), ("T", "C", 0.0, 10.0), ("U", "D", 5.0, 10.0)], "sta string, net string, starttime double, endtime double")
    got = {r.k: (r.net, r.n_sites) for r in lookup.network_from_sites(arr, site).collect()}
    assert got == {1: ("A", 1), 2: ("OLD", 2), 3: (None, 0)}


def test_gathers(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 1.0, [1.0, 2.0]), (1, 2, 0.0, 1.0, [3.0, 4.0]), (2, 3, 0.0, 1.0, [5.0]), (2, 4, 1.0, 1.0, [6.0])], "e int, i int, t0 double, dt double, data array<double>")
    rows = {r.e: r for r in gather.gather(df, ["e"], ["i"]).collect()}
    assert rows[1].matrix == [[1.0, 2.0], [3.0, 4.0]] and rows[1].regular and not rows[2].regular and rows[1].headers[1].i == 2
    part = gather.subset(gather.gather(df, ["e"], ["i"]), 1).filter("e = 1").first()
    assert part.matrix == [[3.0, 4.0]] and part.size == 1
    assert gather.gather(df, ["e"], ["i"]).select(gather.member("matrix", 5).alias("m")).first().m is None
    grid = map_records(df, lambda x, t0, dt: gather.regrid(x, t0, dt, 0.0, 0.5, 3), ["data", "t0", "dt"], {"data": "array<double>", "t0": "double", "dt": "double"})
    assert grid.filter("i = 1").first().data == [1.0, 1.5, 2.0]


def test_gathers_grow_and_are_kept(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, 0.0, 1.0, [1.0, 2.0]), (2, 3, 0.0, 1.0, [5.0])], "e int, i int, t0 double, dt double, data array<double>")
    late = spark.createDataFrame([(1, 9, 0.0, 1.0, [7.0, 8.0]), (1, 8, 0.0, 1.0, [7.0]), (1, 7, 2.0, 1.0, None), (4, 6, 0.0, 1.0, [1.0])], df.schema)
    gathers = gather.gather(df, ["e"], ["i"])
    assert {r.i: r.live for r in gather.fitting(gathers, late, ["e"]).collect()} == {9: True, 8: False, 7: False, 6: False}
    grown = gather.append(gathers, late, ["e"], ["i"])
    assert grown.columns == gathers.columns
    gather.save_gathers(grown, str(tmp_path / "g"))
    rows = {r.e: r for r in gather.read_gathers(spark, str(tmp_path / "g")).collect()}
    assert rows[1].matrix == [[1.0, 2.0], [7.0, 8.0]] and rows[1].size == 2 and rows[1].regular and [h.i for h in rows[1].headers] == [1, 9]
    assert rows[2].matrix == [[5.0]] and rows[2].size == 1 and rows[2].regular
    assert gather.read_gathers(spark, str(tmp_path / "g"), {"e": {"$gt": 1}}).count() == 1
    assert not gather.append(gathers, late.filter("i = 9").withColumn("t0", F.lit(3.0)), ["e"], ["i"]).filter("e = 1").first().regular


def test_response(spark):
    channel = spark.createDataFrame([("1", "N", "S", "BHZ", "", 0.0, 10.0, b"a"), ("2", "N", "S", "BHZ", "", 5.0, 20.0, b"b")], "_id string, net string, sta string, chan string, loc string, starttime double, endtime double, response binary")
    assert [tuple(r) for r in lookup.response(channel, "N", "S", "BHZ", 7.0).collect()] == [(b"a", 2)]
    assert [tuple(r) for r in lookup.response(channel, "N", "S", "BHZ", 15.0).collect()] == [(b"b", 1)]
    assert lookup.response(channel, "N", "S", "BHZ", 30.0).isEmpty()
    with pytest.raises(ValueError):
        lookup.response(channel, "N", None, "BHZ", 7.0)


def test_members_without_wavelet(spark):
    df = spark.createDataFrame([(1, 1.0, [[2.0, 4.0]]), (2, 1.0, [[2.0, 4.0]])], "e int, dt double, data array<array<double>>")
    beams = spark.createDataFrame([(1, [2.0], [0.0, 0.0])] * 2, "e int, wavelet array<double>, noise_power array<double>")
    rows = {r.e: r for r in deconvolve_members(df, beams, ["e"], shape="none").collect()}
    assert np.allclose(rows[1].data, [[1.0, 2.0]]) and rows[1].live and not rows[2].live


def test_command_line(spark, tmp_path, capsys):
    spark.createDataFrame([("1", "x"), ("a", None)], "n string, name string").write.parquet(str(tmp_path / "t"))
    (tmp_path / "s.json").write_text(json.dumps({"n": {"type": "int"}, "name": {"constraint": "required"}}))
    assert cli.main(["verify", str(tmp_path / "t"), str(tmp_path / "s.json")]) == 1
    assert "types: 1 rows" in capsys.readouterr().out
    assert cli.main(["clean", str(tmp_path / "t"), str(tmp_path / "s.json"), str(tmp_path / "o"), "--rename", "name:label", "--fix"]) == 0
    assert dict(spark.read.parquet(str(tmp_path / "o")).dtypes) == {"n": "bigint", "label": "string"}


def record_rows(spark, n=60):
    rows = [(i, f"d{i % 3}", f"f{i % 2}", [float(i), float(i) / 2, -1.0][: 1 + i % 3]) for i in range(n)]
    return spark.createDataFrame(rows, "i int, dir string, dfile string, data array<double>").repartition(4)


def test_records_round_trip(spark, tmp_path):
    from quakeframe.sources.byterange import read_records, save_records

    df = record_rows(spark)
    root, header = str(tmp_path / "wf"), str(tmp_path / "header")
    save_records(kill_if(df, F.col("i") == 5, "t", "dead"), root, header, ["i"])
    want = {r.i: r.data for r in df.collect() if r.i != 5}
    back = read_records(spark, header, "file:" + root)
    assert {r.i: r.data for r in back.filter("live").collect()} == want
    offsets = {}
    for r in sorted(back.collect(), key=lambda r: r.i):
        assert r.foff == offsets.get((r.dir, r.dfile), 0) and r.nbytes == 8 * len(r.data)
        offsets[r.dir, r.dfile] = r.foff + r.nbytes
    assert not [p for p in (tmp_path / "wf").rglob("*") if p.name.startswith(".") and not p.name.endswith(".crc")]
    for dtype in (">f4", "<i4"):
        save_records(df.filter("i % 2 = 0"), f"{root}{dtype[1:]}", f"{header}{dtype[1:]}", ["i"], dtype=dtype)
        again = read_records(spark, f"{header}{dtype[1:]}", f"{root}{dtype[1:]}", dtype)
        assert {r.i: r.data for r in again.collect()} == {r.i: [float(np.float64(x).astype(dtype)) for x in r.data] for r in df.collect() if r.i % 2 == 0}


def test_records_are_planned_by_bytes_and_filters(spark, tmp_path):
    from quakeframe.sources.byterange import ByteRangeReader, FilteringReader, read_records, save_records

    root, header = str(tmp_path / "wf"), str(tmp_path / "header")
    save_records(record_rows(spark), root, header, ["i"])
    spark.read.parquet(header).coalesce(1).sortWithinPartitions("i").write.parquet(header + "1")
    options = {"header": header + "1", "root": root, "maxbytes": "100"}
    slices = ByteRangeReader(options).partitions()
    assert sum(s.rows for s in slices) == 60 and max(s.rows for s in slices) == 100 // 24
    assert all(sum(8 * len(x) for b in ByteRangeReader(options).read(s) for x in b.column("data").to_pylist()) <= 100 for s in slices)
    none = ByteRangeReader(options | {"where": '[["i", ">", 100]]'})
    assert [s.path for s in none.partitions()] == [""] and list(none.read(none.partitions()[0])) == []
    for op, v, keep in ((">=", 57, lambda i: i >= 57), ("==", 9, lambda i: i == 9), ("in", [1, 99], lambda i: i in (1, 99)), ("<", 2, lambda i: i < 2), ("<=", 1, lambda i: i <= 1)):
        assert sorted(r.i for r in read_records(spark, header, root, where=[("i", op, v)]).collect()) == [i for i in range(60) if keep(i)]
    # files that no row names are not opened
    (tmp_path / "wf" / "d1" / "f0").unlink()
    (tmp_path / "wf" / "d1" / "f0").mkdir()
    assert read_records(spark, header, root, where=[("dir", "in", ["d0", "d2"])]).filter("NOT live").count() == 0
    assert read_records(spark, header, root).filter("NOT live").count() == 10
    from pyspark.sql.datasource import EqualTo, IsNotNull

    pushing = FilteringReader(options)
    left = IsNotNull(("i",))
    assert list(pushing.pushFilters([EqualTo(("dir",), "d0"), left])) == [left] and pushing.tests == [("dir", "==", "d0")]


def test_ranges_of_headers(spark, tmp_path):
    from quakeframe.sources.byterange import read_samples, save_records

    root, header = str(tmp_path / "wf"), str(tmp_path / "header")
    save_records(record_rows(spark), root, header, ["i"])
    heads = spark.read.parquet(header).select("i", "dir", "dfile", "foff", F.expr("nbytes div 8 AS npts"))
    more = spark.sql("SELECT * FROM VALUES (100, 'd0', 'none', 0L, 2L), (101, 'd0', 'f0', -8L, 2L), (102, 'd0', 'f0', 0L, 1000L), (103, 'd0', 'f0', NULL, 1L), (104, '/d0/', 'f0', 0L, 0L), (105, NULL, 'f0', 0L, 1L) t(i, dir, dfile, foff, npts)")
    rows = heads.unionByName(more).unionByName(heads.filter("i = 7"))
    for most in (16, 1 << 26):
        got = read_samples(rows, root, most_bytes=most).collect()
        assert len(got) == 67 and sorted(r.i for r in got if not r.live) == [100, 101, 102, 103, 105]
        want = {r.i: r.data for r in record_rows(spark).collect()} | {104: []}
        assert all(r.data == want[r.i] for r in got if r.live)


def test_arrivals_and_catalogs(spark):
    from quakeframe.functions import arrays
    from quakeframe.sources import payload

    df = spark.createDataFrame([(1, 100.0, 1.0, [float(k) for k in range(20)], 110.0), (2, 100.0, 1.0, [0.0] * 20, None)], "i int, t0 double, dt double, data array<double>, p double")
    rows = {r.i: r for r in payload.arrival_reference(df, "p", -2.0, 3.0).collect()}
    assert rows[1].data == [8.0, 9.0, 10.0, 11.0, 12.0, 13.0] and rows[1].t0 == -2.0 and not rows[2].live
    events = spark.sql("SELECT 1 AS evid, 'b' AS preferred, array(named_struct('id', 'a', 'lat', 1D, 'lon', 1D, 'depth', 1D, 'time', 1D), named_struct('id', 'b', 'lat', 2D, 'lon', 2D, 'depth', 2D, 'time', 2D)) AS origins, array(5.5D) AS magnitudes")
    assert tuple(payload.flatten_catalog(events).first()) == (1, 2.0, 2.0, 2.0, 2.0, 5.5)
    c = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]], [2.0, 0.0, 1.0, 0.0, 3.0, 0.0, 0.0, 1.0, 1.0])], "c array<array<double>>, m array<double>")
    turned = c.withColumn("t", arrays.matrix_times("c", arrays.from_flat("m")))
    back = turned.select(arrays.rotate_to_standard("t", "m").alias("b")).first().b
    assert np.allclose(back, [[1, 2], [3, 4], [5, 6]])
    enz = c.select(arrays.oriented("c", F.array(F.lit(90.0), F.lit(0.0), F.lit(0.0)), F.array(F.lit(90.0), F.lit(90.0), F.lit(0.0))).alias("b")).first().b
    assert np.allclose(enz, [[1, 2], [3, 4], [5, 6]])
    m = np.array(c.select(F.array(*[F.array(*r) for r in arrays.rotation(0.3, 0.2)]).alias("m")).first().m)
    assert np.allclose(m @ m.T, np.eye(3))


def test_links_make_no_pairs(spark):
    """The last hit, and the first with an evid, whatever number of sources the band holds."""
    wf = spark.range(40).selectExpr("id AS k", "CASE WHEN id = 3 THEN NULL ELSE 1.7e9 + id * 0.5 END AS starttime")
    src = spark.range(70).selectExpr("id AS _id", "1.7e9 + (id * 29 % 31) * 0.75 - 4 AS time", "CASE WHEN id % 5 = 0 THEN id END AS evid")
    rows = src.collect()
    for prefer in (False, True):
        out = lookup.link_sources(wf, src, 2.0, prefer_evid=prefer)
        assert "explode(array((" not in out._jdf.queryExecution().optimizedPlan().toString()
        got = {r.k: r.source_id for r in out.collect()}
        assert len(got) == 40
        for r in wf.collect():
            hits = sorted((s.time, s._id, s.evid) for s in rows if r.starttime is not None and abs(s.time - r.starttime) <= 2)
            known = [h for h in hits if h[2] is not None] if prefer else []
            assert got[r.k] == ((known or hits[-1:])[0][1] if hits else None)


def test_packets_of_a_long_file_stream(spark):
    """Batches smaller than a file cut no segment, and null codes are codes."""
    own = {"net": F.lit("N"), "sta": F.lit(None).cast("string"), "loc": F.lit(""), "chan": F.expr("IF(id % 30 < 20, 'a', 'b')"), "starttime": F.col("id") * 10.0, "npts": F.lit(10).cast("long"), "rate": F.lit(1.0)}
    df = spark.range(90).withColumns({"path": F.expr("IF(id < 45, 'x', 'y')"), **own, "foff": F.expr("(id % 45) * 512"), "nbytes": F.lit(512).cast("long")})
    found = miniseed.index_packets(df)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = sorted((r.path, r.chan, r.foff // 512, r.npackets, r.npts, r.starttime, r.endtime) for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    runs = [("x", "a", 0, 20), ("x", "a", 30, 15), ("x", "b", 20, 10), ("y", "a", 15, 20), ("y", "b", 5, 10), ("y", "b", 35, 10)]
    runs.insert(3, ("y", "a", 0, 5))
    starts = {"x": 0, "y": 45}
    assert got == [(p, c, o, n, n * 10, (starts[p] + o) * 10.0, (starts[p] + o + n) * 10.0 - 1) for p, c, o, n in runs]
