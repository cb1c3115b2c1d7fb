"""Numeric kernels over the embeddings as series. SQL has no filters or transforms; the kernels are
tested against plain NumPy and analytic identities, and where a sum is known in closed form it is
the SQL."""

import numpy as np
from pyspark.sql import functions as F

from quakeframe.functions import decon, signal, spectral
from quakeframe.functions.array_decon import deconvolve_members
from quakeframe.functions.kernels import map_records
from quakeframe.operators import group, merging, stacking, window
from quakeframe.plans.registry import query, rounded, series


def mapped(t, f, outputs, inputs=("data", "dt")):
    return map_records(series(t), f, list(inputs), outputs)


def weighted(data="data"):
    """The sum of samples times their place, which tells their order."""
    return rounded(F.aggregate(F.transform(data, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x), 5).alias("weighted")


@query("bandpass")
def _(t):
    return mapped(t, lambda x, dt: {"data": signal.filtered(x, dt, "bandpass", [0.1, 0.6], 4)}, {"data": "array<double>"}).select("vec_id", "data")


@query("zero_phase_lowpass")
def _(t):
    return mapped(t, lambda x, dt: {"data": signal.filtered(x, dt, "lowpass", [0.4], 3, True)}, {"data": "array<double>"}).select("vec_id", "data")


@query("detrend_polynomial")
def _(t):
    return mapped(t, lambda x, dt: {"data": signal.detrended(x, "polynomial", 3)}, {"data": "array<double>"}).select("vec_id", "data")


@query("interpolate")
def _(t):
    return mapped(t, lambda x, dt: {"data": signal.interpolated(x, 0.0, dt, 5.0)[0]}, {"data": "array<double>"}).select("vec_id", "data")


@query(
    "interpolate_quadratic",
    "SELECT vec_id, i::INTEGER AS i, round(embedding[i + 1]::DOUBLE, 6) AS x FROM embeddings, range(64) r(i)",
)
def _(t):
    """The spline goes through the samples."""
    out = mapped(t, lambda x, dt: {"data": signal.interpolated(x, 0.0, dt, 6.0, method="quadratic")[0][::3]}, {"data": "array<double>"})
    return out.select("vec_id", F.posexplode("data").alias("i", "y")).select("vec_id", "i", rounded("y").alias("x"))


@query(
    "interpolate_linear",
    "SELECT vec_id, 127 AS npts, round(2 * list_sum(list_transform(embedding, lambda x: x::DOUBLE)) - (embedding[1]::DOUBLE + embedding[64]::DOUBLE) / 2, 6) AS total FROM embeddings",
)
def _(t):
    out = mapped(t, lambda x, dt: {"data": signal.interpolated(x, 0.0, dt, 4.0, method="linear")[0]}, {"data": "array<double>"})
    return out.select("vec_id", F.size("data").alias("npts"), rounded(F.aggregate("data", F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query("fft_resample")
def _(t):
    return mapped(t, lambda x, dt: {"data": signal.fft_resampled(x, dt, 1.5)}, {"data": "array<double>"}).select("vec_id", "data")


@query("decimate")
def _(t):
    return mapped(t, lambda x, dt: {"data": signal.decimated(x, 4)}, {"data": "array<double>"}).select("vec_id", "data")


@query(
    "xcorr_max",
    """WITH s AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS d FROM embeddings), b AS (SELECT d AS r FROM s ORDER BY vec_id LIMIT 1),
    l AS (SELECT vec_id, k, CASE WHEN k >= 0 THEN list_dot_product(d[k + 1:64], r[1:64 - k]) ELSE list_dot_product(d[1:64 + k], r[1 - k:64]) END AS c FROM s, b, (SELECT unnest(range(-8, 9)) AS k))
    SELECT vec_id, arg_max(k, abs(c))::INTEGER AS lag, round(arg_max(c, abs(c)), 6) AS value FROM l GROUP BY vec_id""",
)
def _(t):
    s = series(t)
    first = s.agg(F.min(F.struct("vec_id", "data")).alias("f")).select(F.col("f.data").alias("r"))
    both = s.join(F.broadcast(first))

    def lag(x, r):
        k, v = signal.xcorr_max(signal.cross_correlation(x, r, 8, False, False))
        return {"lag": k, "value": v}

    return map_records(both, lag, ["data", "r"], {"lag": "int", "value": "double"}).select("vec_id", "lag", rounded("value").alias("value"))


@query("detections")
def _(t):
    def found(x, dt):
        c = signal.template_correlation(x, x[20:30])
        return {"found": [{"sample": k, "value": v} for k, v in signal.detections(c, 0.6, 5)]}

    return mapped(t, found, {"found": "array<struct<sample:int,value:double>>"}).select("vec_id", F.explode("found").alias("d")).select("vec_id", "d.*")


@query("mt_spectrum_power", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / 64, 9) AS power FROM embeddings")
def _(t):
    def power(x, dt):
        s = spectral.multitaper_spectrum(x, dt)
        return {"power": float(s["spectrum"].sum() * s["df"])}

    return mapped(t, power, {"power": "double"}).select("vec_id", rounded("power", 9).alias("power"))


@query("bandwidth")
def _(t):
    def band(x, dt):
        s, n = (spectral.multitaper_spectrum(p, dt) for p in (x[32:] * 3, x[:32]))
        return spectral.bandwidth(s["spectrum"], n["spectrum"], s["df"], 1.5, 0.5)

    return mapped(t, band, {"low": "double", "high": "double", "low_snr": "double", "high_snr": "double"}).select("vec_id", "low", "high", "low_snr", "high_snr")


@query("fd_snr")
def _(t):
    kinds = dict.fromkeys(("low_f_band_edge", "high_f_band_edge", "snr_median", "snr_filtered_L2", "snr_filtered_MAD"), "double")

    def metrics(x, dt):
        out = spectral.fd_snr(x, dt, (0, 31), (32, 63))
        return {k: out.get(k) for k in kinds}

    return mapped(t, metrics, kinds).select("vec_id", *kinds)


#: The inverse of the wavelet over 128 frequencies, and its convolution with the data, in SQL.
DECON = """WITH w AS (SELECT j, exp(-0.5 * j * j / 4) AS w FROM range(8) r(j)),
k AS (SELECT k, sum(w * cos(2 * pi() * j * k / 128)) AS re, -sum(w * sin(2 * pi() * j * k / 128)) AS im FROM w, range(128) r(k) GROUP BY k),
e AS (SELECT sum(w * w) AS power FROM w), q AS ({inverse}),
h AS (SELECT l, sum(re * cos(2 * pi() * l * k / 128) - im * sin(2 * pi() * l * k / 128)) / 128 AS h FROM q, range(128) r(l) GROUP BY l),
s AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
p AS (SELECT i, sum(CASE WHEN i - lag = j THEN w * a ELSE 0 END) AS p FROM range(64) r(i), w, (VALUES (5, 1.0), (20, -0.4)) v(lag, a) GROUP BY i),
d AS (SELECT vec_id, i, p + 0.001 * x AS d FROM s JOIN p USING (i))
SELECT vec_id, t::INTEGER AS i, round(sum(d * h), 6) + 0.0::DOUBLE AS rf FROM d, range(64) r(t) JOIN h ON h.l = (t - d.i + 128) % 128 GROUP BY vec_id, t"""


def _decon(name, method, inverse=None, **options):
    @query(name, DECON.format(inverse=inverse) if inverse else None)
    def _(t):
        def run(x, dt):
            wavelet = np.exp(-0.5 * np.arange(8) ** 2 / 4)
            kernel = signal.sparse_convolve(np.array([5, 20]), np.array([1.0, -0.4]), wavelet, 64) + 0.001 * x
            noise = 0.01 * x if method in ("MultiTaperXcor", "MultiTaperSpecDiv", "NoiseStable") else None
            return {"rf": decon.deconvolve(method, kernel, wavelet, dt, noise, **options)}

        out = mapped(t, run, {"rf": "array<double>"})
        if not inverse:
            return out.select("vec_id", "rf")
        return out.select("vec_id", F.posexplode("rf").alias("i", "y")).select("vec_id", "i", (rounded("y") + 0.0).alias("rf"))


_decon(
    "waterlevel",
    "WaterLevel",
    "SELECT k, re * f / g AS re, -im * f / g AS im FROM (SELECT *, greatest(1, 0.05 * sqrt(power) / sqrt(re * re + im * im)) AS f, (re * re + im * im) * greatest(1, 0.05 * sqrt(power) / sqrt(re * re + im * im)) ** 2 AS g FROM k, e)",
    level=0.05,
)
_decon("ls_decon", "LeastSquares", "SELECT k, re / (re * re + im * im + 0.0001 * power) AS re, -im / (re * re + im * im + 0.0001 * power) AS im FROM k, e", damping=0.01)
_decon("td_ls_decon", "TimeDomainLeastSquares", damping=0.01)
_decon("mt_xcor_decon", "MultiTaperXcor")
_decon("mt_specdiv_decon", "MultiTaperSpecDiv")
_decon("noise_stable_decon", "NoiseStable")


@query(
    "gid_decon",
    """WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS d FROM embeddings),
    b AS (SELECT vec_id, arg_max(i, abs(d[i]))::INTEGER AS top FROM s, range(1, 49) r(i) GROUP BY vec_id)
    SELECT vec_id, (top - 1)::INTEGER AS lag, round(d[top], 6) AS a0, round(-0.5 * d[top], 6) AS a1 FROM s JOIN b USING (vec_id)""",
)
def _(t):
    """The largest of the first 48 samples as a spike in two components, found again by the leaf inverse."""

    def run(x, dt):
        wavelet = np.exp(-0.5 * np.arange(8) ** 2 / 4)
        at = int(np.argmax(np.abs(x[:48])))
        three = np.array([signal.sparse_convolve(np.array([at]), np.array([a * x[at]]), wavelet, 64) for a in (1.0, -0.5)])
        found = decon.iterative(three, wavelet, dt, stop=1e-6, inverse="least_squares")
        first = found["amplitudes"][0]
        return {"lag": int(found["lags"][0]), "a0": float(first[0]), "a1": float(first[1])}

    return mapped(t, run, {"lag": "int", "a0": "double", "a1": "double"}).select("vec_id", "lag", rounded("a0").alias("a0"), rounded("a1").alias("a1"))


@query(
    "array_decon",
    """WITH v AS (SELECT vec_id, label % 4 + 1 AS a, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)
    SELECT vec_id, i::INTEGER AS i, round(x * a / (a * a + 0.128), 6) + 0.0::DOUBLE AS x, round(-x * a / (a * a + 0.128), 6) + 0.0::DOUBLE AS y FROM v""",
)
def _(t):
    """Two components by a spike as high as the ensemble tells, over white noise."""
    s = series(t).withColumn("data", F.array("data", F.transform("data", lambda x: -x)))
    wavelet = F.concat(F.array((F.col("label") % 4 + 1).cast("double")), F.array_repeat(F.lit(0.0), 7)).alias("wavelet")
    beams = s.select("label").distinct().select("label", wavelet, F.array_repeat(F.lit(0.001), 4).alias("noise_power"))
    out = deconvolve_members(s, beams, ["label"], shape="none")
    both = F.arrays_zip(F.col("data")[0].alias("x"), F.col("data")[1].alias("y"))
    return out.select("vec_id", F.posexplode(both).alias("i", "z")).select("vec_id", "i", (rounded("z.x") + 0.0).alias("x"), (rounded("z.y") + 0.0).alias("y"))


@query("robust_stack_dbxcor")
def _(t):
    stacks, members = stacking.robust_stacks(series(t), ["label"], ["vec_id"])
    weights = members.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "weight"))), lambda m: m["weight"]).alias("weights"))
    return stacks.join(weights, "label").select("label", "stack", "weights", "rounds")


_round = """t{0} AS (SELECT label, vec_id, sum(x * b) / sqrt(nullif(sum(b * b), 0)) AS along, sum(x * x) AS xx FROM x JOIN b{0} USING (label, i) GROUP BY label, vec_id),
    w{0} AS MATERIALIZED (SELECT label, vec_id, abs(along) / (sqrt(greatest(xx - along * along, 1e-32 * xx)) * sqrt(xx)) AS w FROM t{0}),
    b{1} AS MATERIALIZED (SELECT label, i, sum(w * x) / sum(w) AS b FROM x JOIN w{0} USING (label, vec_id) GROUP BY label, i)"""


@query(
    "robust_stack_rounds",
    f"""WITH x AS MATERIALIZED (SELECT label, vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
    b0 AS MATERIALIZED (SELECT label, i, median(x) AS b FROM x GROUP BY label, i), {", ".join(_round.format(k, k + 1) for k in range(3))},
    n AS (SELECT label, max(w) AS top FROM w2 GROUP BY label)
    SELECT label, vec_id, round(w / top, 6) AS weight, (SELECT round(sum(b * i), 5) FROM b3 WHERE b3.label = w2.label) AS weighted FROM w2 JOIN n USING (label)""",
)
def _(t):
    """Three rounds for every ensemble: weights of the members, and the stack's samples times their place."""
    stacks, members = stacking.robust_stacks(series(t), ["label"], ["vec_id"], eps=0.0, most=3)
    return members.join(stacks.select("label", weighted("stack")), "label").select("label", "vec_id", rounded("weight").alias("weight"), "weighted")


@query("align_and_stack")
def _(t):
    first = lambda live: live.groupBy("label").agg(F.min_by("data", "vec_id").alias("beam"))
    stacks, members = stacking.align_and_stack(series(t), ["label"], ["vec_id"], first, 5, (16, 47))
    lags = members.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "lag"))), lambda m: m["lag"].cast("int")).alias("lags"))
    return stacks.join(lags, "label").select("label", "lags", "converged")


@query(
    "agc",
    """WITH v AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
    g AS (SELECT *, 1 / sqrt(avg(x * x) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)) AS gain FROM v)
    SELECT vec_id, i::INTEGER AS i, round(x * gain, 6) AS x, round(gain, 6) AS gain FROM g""",
)
def _(t):
    out = window.agc(series(t), 5.0)
    return out.select("vec_id", F.posexplode(F.arrays_zip("data", "gain")).alias("i", "y")).select("vec_id", "i", rounded("y.data").alias("x"), rounded("y.gain").alias("gain"))


@query(
    "agc_components",
    """WITH v AS (SELECT label, vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
    m AS (SELECT label, i, avg(x * x) AS p FROM v GROUP BY label, i), g AS (SELECT label, i, 1 / sqrt(avg(p) OVER (PARTITION BY label ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) AS gain FROM m)
    SELECT label, i::INTEGER AS i, round(gain, 6) AS gain FROM g""",
)
def _(t):
    members = group.fold(series(t).select("label", "vec_id", "data"), ["label"], ["vec_id"]).select("label", F.lit(0.5).alias("dt"), F.transform("members", lambda m: m["data"]).alias("data"))
    return window.agc(members, 3.0).select("label", F.posexplode("gain").alias("i", "g")).select("label", "i", rounded("g").alias("gain"))


@query("components_window", "SELECT label, count(*) AS n, 11 AS npts, round(sum(list_sum(list_transform(embedding[11:21], lambda x: x::DOUBLE))), 6) AS total, 5.0::DOUBLE AS t0 FROM embeddings GROUP BY label")
def _(t):
    members = group.fold(series(t).select("label", "vec_id", "data"), ["label"], ["vec_id"]).select("label", F.lit(0.0).alias("t0"), F.lit(0.5).alias("dt"), F.transform("members", lambda m: m["data"]).alias("data"))
    out = window.window_components(members, F.lit(5.0), F.lit(10.0))
    total = F.aggregate(F.flatten("data"), F.lit(0.0), lambda s, x: s + x)
    return out.select("label", F.size("data").cast("long").alias("n"), F.size(F.col("data")[0]).alias("npts"), rounded(total).alias("total"), "t0")


@query(
    "merge_segments",
    "SELECT vec_id, 64 AS npts, 0 AS n_gaps, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total, round(list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * i)), 5) AS weighted, true AS live FROM embeddings",
)
def _(t):
    s = series(t)
    first = s.withColumn("data", F.slice("data", 1, 40))
    second = s.withColumns({"data": F.slice("data", 31, 34), "t0": F.lit(15.0)})
    out = merging.merge(first.unionByName(second), ["vec_id"], fix_overlaps=True)
    return out.select("vec_id", F.size("data").alias("npts"), F.size("gaps").alias("n_gaps"), rounded(F.aggregate("data", F.lit(0.0), lambda s, x: s + x)).alias("total"), weighted(), "live")


@query(
    "merge_gaps",
    """SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 0 ELSE 64 END AS npts, true AS has_gap, CASE WHEN vec_id % 2 = 0 THEN 0.0
    ELSE round(list_sum(list_transform(embedding, lambda x, i: CASE WHEN i BETWEEN 21 AND 30 THEN 0.0 ELSE x::DOUBLE * i END)), 5) END AS weighted, vec_id % 2 <> 0 AS live FROM embeddings""",
)
def _(t):
    s = series(t)
    first = s.withColumn("data", F.slice("data", 1, 20))
    second = s.withColumns({"data": F.slice("data", 31, 34), "t0": F.lit(15.0)})
    both = first.unionByName(second)
    keep = merging.merge(both.filter("vec_id % 2 <> 0"), ["vec_id"], zero_gaps=True)
    return keep.unionByName(merging.merge(both.filter("vec_id % 2 = 0"), ["vec_id"])).select("vec_id", F.size("data").alias("npts"), "has_gap", weighted(), "live")


@query(
    "merge_long_series",
    """WITH s AS (SELECT label, vec_id * 32.0 AS t0, list_transform(embedding, lambda x: x::DOUBLE) AS data FROM embeddings),
    x AS (SELECT label, ((t0 - min(t0) OVER (PARTITION BY label)) / 0.5)::BIGINT + generate_subscripts(data, 1) - 1 AS pos, unnest(data) AS x FROM s),
    n AS (SELECT label, max(pos) + 1 AS n FROM x GROUP BY label), c AS (SELECT label, unnest(range((n - 1) // 4096 + 1)) AS chunk, n FROM n),
    f AS (SELECT label, min(t0) AS t FROM s GROUP BY label)
    SELECT c.label, c.chunk, t + c.chunk * 2048.0 AS t0, least(4096, n - c.chunk * 4096)::INTEGER AS npts, round(coalesce(sum(x.x * (x.pos % 4096 + 1)), 0.0), 5) AS weighted
    FROM c JOIN f USING (label) LEFT JOIN x ON x.label = c.label AND x.pos // 4096 = c.chunk GROUP BY ALL""",
)
def _(t):
    """All series of a label, one after the other by vec_id, as chunks of one; what lies between is zero."""
    s = series(t).withColumn("t0", F.col("vec_id") * 32.0)
    chunks, _ = merging.merge_chunks(s, ["label"], zero_gaps=True, chunk=4096)
    return chunks.select("label", "chunk", "t0", F.size("data").alias("npts"), weighted())


@query("bundle_three_components", "SELECT label::VARCHAR AS sta, count(DISTINCT vec_id % 3) = 3 AS live FROM embeddings GROUP BY label")
def _(t):
    chan = F.concat(F.lit("BH"), F.element_at(F.array(F.lit("E"), F.lit("N"), F.lit("Z")), (F.col("vec_id") % 3 + 1).cast("int")))
    df = series(t).select(F.lit("XX").alias("net"), F.col("label").cast("string").alias("sta"), F.lit("00").alias("loc"), chan.alias("chan"), "t0", "dt", F.size("data").alias("npts"), "data")
    return group.bundle_triples(df).select("sta", "live")


@query("error_kills", "SELECT vec_id, label <> 3 AS live, CASE WHEN label = 3 THEN 'bad label' END AS message FROM embeddings")
def _(t):
    def check(x, label):
        if label == 3:
            raise ValueError("bad label")
        return {"peak": float(np.abs(x).max())}

    out = map_records(series(t), check, ["data", "label"], {"peak": "double"})
    return out.select("vec_id", "live", F.get("elog", F.lit(0))["message"].alias("message"))
