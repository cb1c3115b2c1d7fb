"""Windows and sample-array expressions over the embeddings as series."""

from pyspark.sql import functions as F

from quakeframe.functions import arrays as a
from quakeframe.operators import window
from quakeframe.plans.registry import SERIES, query, rounded, series

_S = f"WITH {SERIES} "
SUM = "list_sum(list_transform({0}, lambda x: {1}))"
ABS = "list_transform(data, lambda x: abs(x))"
TOTAL = "round(list_sum(data), 6) AS total"


def total(c="data"):
    return rounded(F.aggregate(c, F.lit(0.0), lambda s, x: s + x))


# samples 10..40 of 0..63 at dt 0.5, t0 0
@query("window_cut", _S + "SELECT vec_id, 31 AS npts, 5.0::DOUBLE AS t0, round(list_sum(data[11:41]), 6) AS total FROM s")
def _(t):
    return window.window_data(series(t), 5.0, 20.0).select("vec_id", F.size("data").alias("npts"), rounded("t0").alias("t0"), total().alias("total"))


@query("window_short_kill", _S + "SELECT vec_id, false AS live, 1 AS n_log FROM s")
def _(t):
    return window.window_data(series(t), 20.0, 40.0).select("vec_id", "live", F.size("elog").alias("n_log"))


@query("window_pad", _S + "SELECT vec_id, 51 AS npts, (-5.0)::DOUBLE AS t0, round(list_sum(data[1:41]), 6) AS total, true AS live FROM s")
def _(t):
    out = window.window_data(series(t), -5.0, 20.0, short="pad")
    return out.select("vec_id", F.size("data").alias("npts"), rounded("t0").alias("t0"), total().alias("total"), "live")


@query("window_truncate", _S + "SELECT vec_id, 24 AS npts, 20.0::DOUBLE AS t0, round(list_sum(data[41:64]), 6) AS total, true AS live FROM s")
def _(t):
    out = window.window_data(series(t), 20.0, 40.0, short="truncate")
    return out.select("vec_id", F.size("data").alias("npts"), rounded("t0").alias("t0"), total().alias("total"), "live")


@query("window_shifted", _S + "SELECT vec_id, round(list_sum(data[label + 3:label + 13]), 6) AS total, 11 AS npts FROM s")
def _(t):
    df = series(t).withColumn("arrival", F.col("label") * 0.5)
    return window.window_data(df, 1.0, 6.0, "arrival").select("vec_id", total().alias("total"), F.size("data").alias("npts"))


@query("autopad", _S + "SELECT vec_id, 66 AS npts, round(list_sum(data), 6) AS total, true AS live FROM s")
def _(t):
    return window.window_autopad(series(t), 0.0, 32.5, 0.05).select("vec_id", F.size("data").alias("npts"), total().alias("total"), "live")


@query("autopad_refused", _S + "SELECT vec_id, false AS live FROM s")
def _(t):
    return window.window_autopad(series(t), 0.0, 40.0, 0.05).select("vec_id", "live")


@query("top_mute", _S + "SELECT vec_id, round(list_sum(list_transform(data, lambda x, i: x * least(1.0, greatest(0.0, ((i - 1) * 0.5 - 2.0) / 4.0)))), 6) AS total FROM s")
def _(t):
    return window.top_mute(series(t), 2.0, 6.0).select("vec_id", total().alias("total"))


@query("zero_gaps", _S + "SELECT vec_id, round(list_sum(data) - list_sum(data[11:21]), 6) AS total FROM s")
def _(t):
    df = series(t).withColumn("gaps", F.expr("array(named_struct('starttime', 5.0D, 'endtime', 10.0D))"))
    return window.zero_gaps(df).select("vec_id", total().alias("total"))


for _name, _f, _sql in (
    ("peak", a.peak, f"list_max({ABS})"),
    ("rms", a.rms, "sqrt(list_sum(list_transform(data, lambda x: x * x)) / 64)"),
    ("perc", lambda c: a.perc(c, 0.95), f"list_sort({ABS})[least(floor(0.95 * 64)::INT, 63) + 1]"),
    ("mad", a.mad, f"list_sort({ABS})[33]"),
):

    @query(f"amp_{_name}", _S + f"SELECT vec_id, round({_sql}, 9) AS amp FROM s")
    def _amp(t, f=_f):
        return series(t).select("vec_id", rounded(f("data"), 9).alias("amp"))


@query("scale_peak", _S + f"SELECT vec_id, round(1 / (2.0 / list_max({ABS})), 6) AS calib, round(list_sum(list_transform(data, lambda x: x * 2.0)) / list_max({ABS}), 6) AS total FROM s")
def _(t):
    df = series(t).withColumn("amp", a.peak("data"))
    return df.select("vec_id", rounded(a.scaled_calib(F.lit(1.0), F.col("amp"), 2.0)).alias("calib"), total(a.scaled("data", F.col("amp"), 2.0)).alias("total"))


@query("scale_section", _S + "SELECT vec_id, round(" + " + ".join(f"list_sum(data[{k + 1}:{k + 16}]) / list_max(list_transform(data[{k + 1}:{k + 16}], lambda x: abs(x)))" for k in (0, 16, 32, 48)) + ", 6) AS total FROM s")
def _(t):
    return series(t).select("vec_id", total(a.scaled_by_section("data", 16)).alias("total"))


@query("taper_linear", _S + "SELECT vec_id, round(list_sum(list_transform(data, lambda x, i: x * CASE WHEN i - 1 <= 4 THEN 0 WHEN i - 1 < 12 THEN (i - 5) / 8.0 WHEN i - 1 >= 60 THEN 0 WHEN i - 1 > 50 THEN (61 - i) / 10.0 ELSE 1 END)), 6) AS total FROM s")
def _(t):
    return series(t).select("vec_id", total(a.linear_taper("data", 4, 12, 50, 60)).alias("total"))


@query("taper_cosine", _S + "SELECT vec_id, round(list_sum(list_transform(data, lambda x, i: x * CASE WHEN i - 1 <= 4 THEN 0 WHEN i - 1 < 12 THEN (1 - cos(pi() * (i - 5) / 8.0)) / 2 WHEN i - 1 >= 60 THEN 0 WHEN i - 1 > 50 THEN (1 - cos(pi() * (61 - i) / 10.0)) / 2 ELSE 1 END)), 6) AS total FROM s")
def _(t):
    return series(t).select("vec_id", total(a.cosine_taper("data", 4, 12, 50, 60)).alias("total"))


@query("taper_vector", _S + "SELECT vec_id, round(list_sum(list_transform(data, lambda x, i: x * (i - 1) / 63.0)), 6) AS total FROM s")
def _(t):
    weights = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i / 63.0)
    return series(t).select("vec_id", total(a.vector_taper("data", weights)).alias("total"))


@query(
    "snr_ratio",
    """WITH s AS (SELECT vec_id, CASE WHEN label = 0 THEN list_transform(embedding, lambda x, i: CASE WHEN i <= 20 THEN 0.0 ELSE x::DOUBLE END) WHEN label = 1 THEN list_transform(embedding, lambda x: 0.0::DOUBLE) ELSE list_transform(embedding, lambda x: x::DOUBLE) END AS data FROM embeddings),
    q AS (SELECT vec_id, sqrt(list_sum(list_transform(data[1:20], lambda x: x * x)) / 20) AS n, list_max(list_transform(data[21:64], lambda x: abs(x))) AS p FROM s)
    SELECT vec_id, round(CASE WHEN n > 0 THEN p / n WHEN p > 0 THEN 999999.9 ELSE -1.0 END, 6) AS snr FROM q""",
)
def _(t):
    zeroed = F.when(F.col("label") == 0, F.transform("data", lambda x, i: F.when(i < 20, 0.0).otherwise(x))).when(F.col("label") == 1, F.transform("data", lambda x: F.lit(0.0))).otherwise(F.col("data"))
    df = series(t).withColumn("data", zeroed)
    return df.select("vec_id", rounded(a.snr("data", (0, 19), (20, 63), "rms", "peak")).alias("snr"))


@query("detrend_constant", _S + "SELECT vec_id, round(list_sum(list_transform(data, lambda x, i: abs(x - list_sum(data) / 64) * i)), 6) AS total FROM s")
def _(t):
    d = series(t).withColumn("d", a.detrend_constant("data"))
    return d.select("vec_id", total(F.transform("d", lambda x, i: F.abs(x) * (i + 1))).alias("total"))


@query(
    "detrend_linear",
    """WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS data FROM embeddings),
    q AS (SELECT vec_id, data, list_sum(data) / 64 AS m, (list_sum(list_transform(data, lambda x, i: x * (i - 1))) - 31.5 * list_sum(data)) / (64 * (64 * 64 - 1) / 12.0) AS b FROM s)
    SELECT vec_id, round(list_sum(list_transform(data, lambda x, i: abs(x - (m + b * (i - 1 - 31.5))))), 6) AS total FROM q""",
)
def _(t):
    d = series(t).withColumn("d", a.detrend_linear("data"))
    return d.select("vec_id", total(F.transform("d", lambda x: F.abs(x))).alias("total"))


_BEAM = """WITH s AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS data FROM embeddings),
b AS (SELECT label, data AS beam FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1),
q AS (SELECT vec_id, data, beam, list_dot_product(data, beam) AS d, sqrt(list_dot_product(data, data)) AS nd, sqrt(list_dot_product(beam, beam)) AS nb FROM s JOIN b USING (label)) """


def beams(t):
    s = series(t)
    first = s.groupBy("label").agg(F.min(F.struct("vec_id", "data")).alias("f")).select("label", F.col("f.data").alias("beam"))
    return s.join(first, "label")


for _name, _f, _sql in (
    ("correlation", a.beam_correlation, "abs(d) / (nd * nb)"),
    ("coherence", a.beam_coherence, "greatest(0.0, 1 - sqrt(greatest(list_sum(list_transform(list_zip(data, beam), lambda z: (z[1] - d / (nb * nb) * z[2]) ** 2)), 0)) / nd)"),
    ("amplitude", a.beam_amplitude, "d / nb / 64"),
):

    @query(f"beam_{_name}", _BEAM + f"SELECT vec_id, round({_sql}, 6) AS metric FROM q")
    def _beam(t, f=_f):
        return beams(t).select("vec_id", rounded(f("data", "beam")).alias("metric"))


@query("remove_incident", _BEAM + "SELECT vec_id, round(list_sum(list_transform(list_zip(data, beam), lambda z: abs(z[1] - d * z[2]))), 6) AS total FROM q")
def _(t):
    left = a.remove_incident("data", "beam")
    return beams(t).select("vec_id", total(F.transform(left, lambda x: F.abs(x))).alias("total"))


@query("phase_time", "SELECT event_id, coalesce(value + nullif(user_id, 7), -1.0) AS phase_time FROM events")
def _(t):
    return t("events").withColumn("u", F.expr("nullif(user_id, 7)")).select("event_id", a.phase_time("value", "u").alias("phase_time"))


@query(
    "dec_factor",
    "SELECT p_partkey, CASE WHEN p_size = 5 THEN 1 WHEN p_size < 5 THEN 0 WHEN p_size % 5 = 0 THEN (p_size // 5)::INTEGER ELSE -1 END AS factor FROM part",
)
def _(t):
    return t("part").select("p_partkey", a.dec_factor(F.col("p_size").cast("double"), 5.0).alias("factor"))


_THREE = "WITH s AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS d FROM embeddings), c AS (SELECT vec_id, radians(90.0 - (label * 36.0 + 180.0)) AS f, d[1:20] AS x, d[21:40] AS y, d[41:60] AS z FROM s) "


def three(t):
    return series(t).select("vec_id", "label", F.array(F.slice("data", 1, 20), F.slice("data", 21, 20), F.slice("data", 41, 20)).alias("c"))


@query("rotate_rtz", _THREE + "SELECT vec_id, round(list_sum(list_transform(list_zip(x, y), lambda v: abs(cos(f) * v[1] + sin(f) * v[2]))), 6) AS r, round(list_sum(list_transform(list_zip(x, y), lambda v: abs(-sin(f) * v[1] + cos(f) * v[2]))), 6) AS t FROM c")
def _(t):
    turned = three(t).withColumn("o", a.rtz("c", a.rtz_angle(F.col("label") * 36.0)))
    return turned.select("vec_id", total(F.transform(F.col("o")[0], lambda x: F.abs(x))).alias("r"), total(F.transform(F.col("o")[1], lambda x: F.abs(x))).alias("t"))


@query("rotate_lqt_energy", _THREE + "SELECT vec_id, round(list_dot_product(x, x) + list_dot_product(y, y) + list_dot_product(z, z), 6) AS energy FROM c")
def _(t):
    turned = three(t).withColumn("o", a.lqt("c", F.col("label") * 36.0, F.lit(25.0)))
    energy = a.dot(F.col("o")[0], F.col("o")[0]) + a.dot(F.col("o")[1], F.col("o")[1]) + a.dot(F.col("o")[2], F.col("o")[2])
    return turned.select("vec_id", rounded(energy).alias("energy"))


@query("amp_3c", _THREE + "SELECT vec_id, round(list_max(list_transform(list_zip(x, y, z), lambda v: sqrt(v[1] ** 2 + v[2] ** 2 + v[3] ** 2))), 6) AS peak, round(sqrt((list_dot_product(x, x) + list_dot_product(y, y) + list_dot_product(z, z)) / 20), 6) AS rms FROM c")
def _(t):
    df = three(t).withColumn("v", a.vector_lengths("c"))
    return df.select("vec_id", rounded(a.peak("v")).alias("peak"), rounded(a.rms("v")).alias("rms"))


@query("extract_component", _THREE + "SELECT vec_id, round(list_sum(z), 6) AS total FROM c")
def _(t):
    return three(t).select("vec_id", total(F.col("c")[2]).alias("total"))


@query(
    "dbxcor_weights_once",
    """WITH s AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS data FROM embeddings),
    x AS (SELECT label, generate_subscripts(data, 1) AS i, unnest(data) AS v FROM s), m AS (SELECT label, i, median(v) AS v FROM x GROUP BY label, i),
    k AS (SELECT label, list(v ORDER BY i) AS stack FROM m GROUP BY label), u AS (SELECT label, list_transform(stack, lambda y: y / sqrt(list_dot_product(stack, stack))) AS unit FROM k),
    p AS (SELECT vec_id, label, data, unit, list_dot_product(data, unit) AS d FROM s JOIN u USING (label)),
    w AS (SELECT vec_id, label, abs(d) / (sqrt(list_sum(list_transform(list_zip(data, unit), lambda z: (z[1] - d * z[2]) ** 2))) * sqrt(list_dot_product(data, data))) AS w FROM p)
    SELECT vec_id, round(w / max(w) OVER (PARTITION BY label), 6) AS weight FROM w""",
)
def _(t):
    from pyspark.sql import Window

    from quakeframe.operators.group import stack_median

    df = series(t)
    joined = df.join(stack_median(df, ["label"]).select("label", "stack"), "label").withColumn("w", a.dbxcor_weight("data", "stack"))
    return joined.select("vec_id", rounded(F.col("w") / F.max("w").over(Window.partitionBy("label"))).alias("weight"))


@query("beam_metrics", _BEAM + "SELECT vec_id, round(abs(d) / (nd * nb), 6) AS xcor_coef, round(d / nb / 64, 6) AS relative_amplitude FROM q")
def _(t):
    from quakeframe.operators.group import beam_metrics

    return beam_metrics(beams(t)).select("vec_id", rounded("xcor_coef").alias("xcor_coef"), rounded("relative_amplitude").alias("relative_amplitude"))
