"""Sample-array expressions: amplitudes, scaling, tapers, ratios, correlation with a beam.

All are Column expressions over ``array<double>``; they stay in the JVM and can be pruned and
pushed like any other.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ratio of a signal over no noise at all.
NO_NOISE = 999999.9


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """body(value) with the value computed once. A column that a lambda mentions is computed anew for
    every element; as the variable of an outer lambda it is not."""
    return F.transform(F.array(value), body)[0]


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x * x))


def peak(a) -> Column:
    """Largest absolute value; 0 of nothing."""
    return F.coalesce(F.array_max(F.transform(col(a), lambda x: F.abs(x))), F.lit(0.0))


def rms(a) -> Column:
    n = F.size(col(a))
    return F.when(n > 0, F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x * x) / n)).otherwise(0.0)


def perc(a, share: float) -> Column:
    """The absolute value at index floor(share * n) of their ascending order, the last one at most.
    A share above 1 is a percentage. No interpolation."""
    p = share / 100.0 if share > 1.0 else share
    n = F.size(col(a))
    at = F.least(F.floor(F.lit(p) * n).cast("int"), n - 1) + 1
    return F.when(n > 0, F.element_at(F.array_sort(F.transform(col(a), lambda x: F.abs(x))), F.greatest(at, F.lit(1)))).otherwise(0.0)


def mad(a) -> Column:
    """The upper median of the absolute values."""
    return perc(a, 0.5)


def vector_lengths(components) -> Column:
    """Length of the 3-component vector at each sample."""
    c = col(components)
    return F.transform(F.arrays_zip(c[0].alias("x"), c[1].alias("y"), c[2].alias("z")), lambda v: F.sqrt(v["x"] ** 2 + v["y"] ** 2 + v["z"] ** 2))


def amplitude(a, method: str, share: float = 0.95) -> Column:
    return {"peak": peak, "rms": rms, "mad": mad, "perc": lambda x: perc(x, share)}[method.lower()](a)


def scaled(a, amp: Column, level: float = 1.0) -> Column:
    """Samples times level / amplitude; unchanged at no amplitude."""
    return let(F.when(amp > 0, F.lit(level) / amp).otherwise(1.0), lambda g: F.transform(col(a), lambda x: x * g))


def scaled_calib(calib, amp: Column, level: float = 1.0) -> Column:
    """The calibration that keeps calib times samples."""
    return F.when(amp > 0, col(calib) / (F.lit(level) / amp)).otherwise(col(calib))


def scaled_by_section(a, length: int, method: str = "peak", level: float = 1.0) -> Column:
    """Each run of ``length`` samples scaled by its own amplitude."""
    n = F.size(col(a))
    starts = F.sequence(F.lit(0), F.floor((n - 1) / length).cast("int"))
    parts = F.transform(starts, lambda k: F.slice(col(a), k * length + 1, length))
    return F.flatten(F.transform(parts, lambda p: scaled(p, amplitude(p, method), level)))


def _taper(a, head0: float, head1: float, tail1: float, tail0: float, ramp) -> Column:
    """Weights by sample number: 0 up to head0, up to 1 at head1, from tail1 down to 0 at tail0."""

    def weight(i):
        w = F.lit(1.0)
        if tail0 > tail1:
            w = F.when(i >= tail0, 0.0).when(i > tail1, ramp((F.lit(float(tail0)) - i) / float(tail0 - tail1))).otherwise(w)
        if head1 > head0:
            w = F.when(i <= head0, 0.0).when(i < head1, ramp((i - float(head0)) / float(head1 - head0))).otherwise(w)
        return w

    return F.transform(col(a), lambda x, i: x * weight(i))


def linear_taper(a, head0, head1, tail1, tail0) -> Column:
    return _taper(a, head0, head1, tail1, tail0, lambda x: x)


def cosine_taper(a, head0, head1, tail1, tail0) -> Column:
    return _taper(a, head0, head1, tail1, tail0, lambda x: (1.0 - F.cos(x * pi)) / 2.0)


def vector_taper(a, weights) -> Column:
    return F.zip_with(col(a), col(weights), lambda x, w: x * w)


def detrend_constant(a) -> Column:
    mean = F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x) / F.size(col(a))
    return let(mean, lambda m: F.transform(col(a), lambda x: x - m))


def detrend_linear(a) -> Column:
    """Less the least-squares line over the sample number."""
    n = F.size(col(a)).cast("double")
    total = F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x)
    weighted = F.aggregate(F.transform(col(a), lambda x, i: x * i), F.lit(0.0), lambda s, x: s + x)
    middle, spread = (n - 1) / 2, F.when(n > 1, n * (n * n - 1) / 12)
    line = F.struct((total / n).alias("mean"), F.coalesce((weighted - middle * total) / spread, F.lit(0.0)).alias("slope"), middle.alias("middle"))
    return let(line, lambda p: F.transform(col(a), lambda x, i: x - (p["mean"] + p["slope"] * (i - p["middle"]))))


def safe_ratio(signal: Column, noise: Column) -> Column:
    """Signal over noise; a fixed large number over no noise, -1 without both."""
    return F.when(noise > 0, signal / noise).when(signal > 0, F.lit(NO_NOISE)).otherwise(F.lit(-1.0))


def snr(a, noise: tuple[int, int], signal: tuple[int, int], noise_metric="mad", signal_metric="mad", share: float = 0.95) -> Column:
    """Ratio of amplitudes in two sample ranges [first, last]."""
    part = lambda r: F.slice(col(a), r[0] + 1, r[1] - r[0] + 1)
    return safe_ratio(amplitude(part(signal), signal_metric, share), amplitude(part(noise), noise_metric, share))


def beam_correlation(a, beam) -> Column:
    """Absolute correlation with the beam; 0 without length."""
    scale = norm(a) * norm(beam)
    return F.when(scale > 0, F.abs(dot(a, beam)) / scale).otherwise(0.0)


def beam_residual(a, beam) -> Column:
    """Samples less their projection on the beam's direction."""
    g = dot(a, beam) / F.aggregate(col(beam), F.lit(0.0), lambda s, x: s + x * x)
    return let(g, lambda k: F.zip_with(col(a), col(beam), lambda x, y: x - k * y))


def beam_coherence(a, beam) -> Column:
    """1 less the share of the norm that the beam leaves; 0 at least."""
    return F.when((norm(a) > 0) & (norm(beam) > 0), F.greatest(F.lit(0.0), 1.0 - let(beam_residual(a, beam), norm) / norm(a))).otherwise(0.0)


def beam_amplitude(a, beam) -> Column:
    """Projection on the unit beam, a sample; -1 without a beam."""
    n = F.size(col(a))
    return F.when((norm(beam) > 0) & (n > 0), dot(a, beam) / norm(beam) / n).otherwise(-1.0)


def dbxcor_weight(a, stack, floor: float = 1e-16) -> Column:
    """Weight of a member against a stack: |projection| over the norms of residual and member."""
    sizes = F.struct(norm(a).alias("a"), norm(stack).alias("s"), dot(a, stack).alias("d"))

    def weight(k):
        along = k["d"] / k["s"]
        rest = let(along / k["s"], lambda g: F.sqrt(F.aggregate(F.zip_with(col(a), col(stack), lambda x, y: (x - g * y) * (x - g * y)), F.lit(0.0), lambda t, x: t + x)))
        return F.when((k["a"] > 0) & (k["s"] > 0), F.abs(along) / (F.greatest(rest, F.lit(floor) * k["a"]) * k["a"])).otherwise(0.0)

    return let(sizes, weight)


def remove_incident(a, beam) -> Column:
    """Less the part along a beam of unit norm."""
    return let(F.when(norm(beam) > 0, dot(a, beam)).otherwise(0.0), lambda p: F.zip_with(col(a), col(beam), lambda x, y: x - p * y))


def phase_time(phase, shift) -> Column:
    return F.coalesce(col(phase) + col(shift), F.lit(-1.0))


def dec_factor(rate: Column, target: float) -> Column:
    """1: same rate, n: decimate by n, 0: upsample, -1: no whole factor."""
    ratio = rate / F.lit(float(target))
    whole = F.floor(ratio)
    close = lambda x, y: F.abs(x - y) <= 1e-5 * F.abs(y) + 1e-8
    return F.when(close(ratio, F.lit(1.0)), 1).when(ratio < 1, 0).when(close(ratio, whole), whole.cast("int")).otherwise(-1)


# three components ------------------------------------------------------------------------------


def matrix_times(components, m) -> Column:
    """A 3x3 matrix (nested lists of numbers or columns) times the 3-component samples."""
    c = col(components)

    def combined(row):
        values = F.struct(*[(v if isinstance(v, Column) else F.lit(float(v))).alias(k) for k, v in zip("pqr", row, strict=True)])
        return let(values, lambda m: F.zip_with(F.zip_with(c[0], c[1], lambda x, y: m["p"] * x + m["q"] * y), c[2], lambda s, z: s + m["r"] * z))

    return F.array(*[combined(row) for row in m])


def rtz(components, phi) -> Column:
    """East, north, up to radial, transverse, up: rotation in the horizontal plane by phi (radians)."""
    a = col(phi) if isinstance(phi, (str, Column)) else F.lit(float(phi))
    zero, one = F.lit(0.0), F.lit(1.0)
    return matrix_times(components, [[F.cos(a), F.sin(a), zero], [-F.sin(a), F.cos(a), zero], [zero, zero, one]])


def rtz_angle(back_azimuth) -> Column:
    """The rotation of ``rtz`` for a back azimuth in degrees."""
    return F.radians(F.lit(90.0) - (col(back_azimuth) + 180.0))


def lqt(components, back_azimuth, emergence) -> Column:
    """East, north, up to longitudinal, SV and transverse, for a back azimuth and an emergence angle
    from the vertical, in degrees."""
    h, t = rtz_angle(back_azimuth), F.radians(col(emergence))
    ch, sh, ct, st = F.cos(h), F.sin(h), F.cos(t), F.sin(t)
    return matrix_times(components, [[ch * st, sh * st, ct], [-ch * ct, -sh * ct, st], [-sh, ch, F.lit(0.0)]])


def free_surface_matrix(ux, uy, vp0, vs0) -> list[list[Column]]:
    """Inverse of the free-surface response for a slowness vector: a matrix for ``matrix_times``.

    With p the length of slowness: radial, transverse and vertical motion to P, SV, SH.
    """
    ux, uy, vp, vs = col(ux), col(uy), col(vp0), col(vs0)
    p2 = ux * ux + uy * uy
    p = F.sqrt(p2)
    qa, qb = F.sqrt(1 / (vp * vp) - p2), F.sqrt(1 / (vs * vs) - p2)
    c, s = F.when(p > 0, ux / p).otherwise(1.0), F.when(p > 0, uy / p).otherwise(0.0)
    vpz, vpr = (1 - 2 * vs * vs * p2) / (2 * vp * qa), p * vs * vs / vp
    vsr, vsz = (1 - 2 * vs * vs * p2) / (2 * vs * qb), p * vs
    zero = F.lit(0.0)
    return [[-0.5 * s, 0.5 * c, zero], [vsr * c, vsr * s, -vsz], [vpr * c, vpr * s, vpz]]


def ator(t0, shift) -> Column:
    return col(t0) - col(shift)


def rtoa(t0, shift) -> Column:
    return col(t0) + col(shift)


def inverse3(m) -> list[list[Column]]:
    """The inverse of a 3x3 matrix of columns or numbers."""
    a = [[v if isinstance(v, Column) else F.lit(float(v)) for v in row] for row in m]
    minor = lambda i, j: a[(i + 1) % 3][(j + 1) % 3] * a[(i + 2) % 3][(j + 2) % 3] - a[(i + 1) % 3][(j + 2) % 3] * a[(i + 2) % 3][(j + 1) % 3]
    det = a[0][0] * minor(0, 0) + a[0][1] * minor(0, 1) + a[0][2] * minor(0, 2)
    return [[minor(j, i) / det for j in range(3)] for i in range(3)]


def from_flat(tmatrix) -> list[list[Column]]:
    """A matrix of columns from an array column of nine values, row by row."""
    return [[F.element_at(col(tmatrix), 3 * i + j + 1) for j in range(3)] for i in range(3)]


def rotate_to_standard(components, tmatrix) -> Column:
    """Components as they were before the transformation matrix was applied."""
    return matrix_times(components, inverse3(from_flat(tmatrix)))


def rotation(phi, theta) -> list[list[Column]]:
    """The matrix that turns axes by the azimuth phi (radians, from the first axis) and then tilts
    the third by theta."""
    p, t = col(phi) if isinstance(phi, (str, Column)) else F.lit(float(phi)), col(theta) if isinstance(theta, (str, Column)) else F.lit(float(theta))
    a, b, c, d = F.cos(p), F.sin(p), F.cos(t), F.sin(t)
    return [[a, -b, F.lit(0.0)], [b * c, a * c, -d], [b * d, a * d, c]]


def oriented(components, hang, vang) -> Column:
    """East, north, up from three channels with azimuths and angles from the vertical, in degrees
    (array columns of three)."""
    direction = []
    for i in (1, 2, 3):
        h, v = F.radians(F.element_at(col(hang), i)), F.radians(F.element_at(col(vang), i))
        direction.append([F.sin(h) * F.sin(v), F.cos(h) * F.sin(v), F.cos(v)])
    return matrix_times(components, inverse3(direction))
