"""Numeric kernels on sample arrays: filters, resampling, correlation. NumPy only."""

from __future__ import annotations

import numpy as np

# Butterworth filters as second-order sections --------------------------------------------------


def butterworth(order: int, corners, kind: str, rate: float) -> np.ndarray:
    """Sections (b0 b1 b2 a0 a1 a2) of a digital Butterworth filter by the bilinear transform.

    ``kind``: lowpass, highpass, bandpass or bandstop; ``corners`` in Hz below half the rate.
    """
    nyquist = rate / 2
    w = np.atleast_1d(np.asarray(corners, float)) / nyquist
    if order < 1 or (w <= 0).any() or (w >= 1).any() or (len(w) == 2 and w[0] >= w[1]):
        raise ValueError("the corners must be in order, above zero and below the Nyquist frequency")
    warped = 4 * np.tan(np.pi * w / 2)  # at two samples a second
    k = np.arange(1, order + 1)
    poles = np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order))
    zeros, gain = np.empty(0, complex), 1.0
    if kind == "lowpass":
        poles, gain = poles * warped[0], warped[0] ** order
    elif kind == "highpass":
        gain = np.real(1 / np.prod(-poles))
        poles, zeros = warped[0] / poles, np.zeros(order, complex)
    elif kind in ("bandpass", "bandstop"):
        width, centre = warped[1] - warped[0], np.sqrt(warped[0] * warped[1])
        if kind == "bandpass":
            half = poles * width / 2
            zeros, gain = np.zeros(order, complex), width**order
        else:
            gain = np.real(1 / np.prod(-poles))
            half = width / 2 / poles
            zeros = np.r_[np.full(order, 1j * centre), np.full(order, -1j * centre)]
        root = np.sqrt(half**2 - centre**2)
        poles = np.r_[half + root, half - root]
    else:
        raise ValueError(f"unknown kind {kind}")
    gain = gain * np.real(np.prod(4 - zeros) / np.prod(4 - poles))
    z = np.r_[(4 + zeros) / (4 - zeros), -np.ones(len(poles) - len(zeros))]
    p = (4 + poles) / (4 - poles)
    return sections(z, p, gain)


def sections(zeros: np.ndarray, poles: np.ndarray, gain: float) -> np.ndarray:
    """Pairs of conjugate (or real) roots as second-order sections; the gain is in the first."""

    def pairs(roots):
        roots = np.asarray(roots, complex)
        upper = roots[roots.imag > 1e-12]
        real = np.sort(roots[np.abs(roots.imag) <= 1e-12].real)
        out = [np.array([1, -2 * r.real, abs(r) ** 2]) for r in upper[np.argsort(np.abs(upper))]]
        for i in range(0, len(real) - 1, 2):
            out.append(np.array([1, -(real[i] + real[i + 1]), real[i] * real[i + 1]]))
        if len(real) % 2:
            out.append(np.array([1, -real[-1], 0.0]))
        return out

    a, b = pairs(poles), pairs(zeros)
    b += [np.array([1.0, 0, 0])] * (len(a) - len(b))
    out = np.array([np.r_[x, y] for x, y in zip(b, a, strict=True)])
    out[0, :3] *= gain
    return out


def run_sections(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Filter through the sections, from rest. A recursion in each section, blockwise by its
    impulse response and the state's free response, so that it runs at array speed."""
    y = np.asarray(x, float).copy()
    n = len(y)
    block = 64
    for b0, b1, b2, a0, a1, a2 in sos:
        b0, b1, b2, a1, a2 = b0 / a0, b1 / a0, b2 / a0, a1 / a0, a2 / a0
        h, free = np.zeros(block), np.zeros((2, block))
        for k in range(block):
            h[k] = (b0 if k == 0 else b1 if k == 1 else b2 if k == 2 else 0.0) - (a1 * h[k - 1] if k > 0 else 0.0) - (a2 * h[k - 2] if k > 1 else 0.0)
        for s, (d1, d2) in enumerate(((1.0, 0.0), (0.0, 1.0))):
            for k in range(block):
                free[s, k] = d1
                d1, d2 = d2 - a1 * free[s, k], -a2 * free[s, k]
        matrix = np.zeros((block, block))
        for k in range(block):
            matrix[k, : k + 1] = h[: k + 1][::-1]
        d1 = d2 = 0.0
        for at in range(0, n, block):
            u = y[at : at + block]
            m = len(u)
            v = matrix[:m, :m] @ u + d1 * free[0, :m] + d2 * free[1, :m]
            # the state of the transposed form after the block
            u1, v1 = u[-1], v[-1]
            if m > 1:
                u2, v2 = u[-2], v[-2]
                d1, d2 = b1 * u1 - a1 * v1 + b2 * u2 - a2 * v2, b2 * u1 - a2 * v1
            else:
                d1, d2 = b1 * u1 - a1 * v1 + d2, b2 * u1 - a2 * v1
            y[at : at + block] = v
    return y


def filtered(x: np.ndarray, dt: float, kind: str, corners, order: int = 4, zerophase: bool = False) -> np.ndarray:
    """A Butterworth filter forwards, or forwards and backwards."""
    sos = butterworth(order, corners, kind, 1 / dt)
    y = run_sections(sos, x)
    return run_sections(sos, y[::-1])[::-1] if zerophase else y


def windowed_sinc(x: np.ndarray, dt: float, corner: float, half: int = 64) -> np.ndarray:
    """A symmetric FIR low pass (Hamming window), zero phase."""
    k = np.arange(-half, half + 1)
    h = 2 * corner * dt * np.sinc(2 * corner * dt * k) * np.hamming(2 * half + 1)
    return np.convolve(x, h / h.sum(), "same")


# trends and grids --------------------------------------------------------------------------------


def detrended(x: np.ndarray, kind: str = "linear", order: int = 2) -> np.ndarray:
    """Less the mean, the line through the ends (simple), a least-squares line, polynomial, or cubic
    spline (``order`` is then the number of samples between its knots)."""
    x = np.asarray(x, float)
    i = np.linspace(-1, 1, len(x)) if len(x) > 1 else np.zeros(len(x))
    if kind in ("constant", "demean") or len(x) < 2:
        return x - x.mean() if len(x) else x
    if kind == "simple":
        return x - np.linspace(x[0], x[-1], len(x))
    if kind == "spline":
        basis = spline_basis(len(x), max(order, 2))
        return x - basis @ np.linalg.lstsq(basis, x, rcond=None)[0]
    degree = {"linear": 1, "polynomial": order}.get(kind)
    if degree is None:
        raise ValueError(f"unknown detrend {kind}")
    return x - np.polynomial.legendre.legval(i, np.polynomial.legendre.legfit(i, x, min(degree, len(x) - 1)))


def spline_basis(n: int, spacing: int, degree: int = 3) -> np.ndarray:
    """B-splines over n samples with a knot every ``spacing`` samples, by the usual recursion."""
    inner = np.arange(spacing, n - 1, spacing, dtype=float)
    knots = np.r_[np.zeros(degree + 1), inner, np.full(degree + 1, float(n - 1))]
    t = np.minimum(np.arange(n, dtype=float), n - 1 - 1e-9)[:, None]
    b = ((t >= knots[:-1]) & (t < knots[1:])).astype(float)
    for k in range(1, degree + 1):
        left, right = knots[k:-1] - knots[: -k - 1], knots[k + 1 :] - knots[1:-k]
        rise = np.where(left > 0, (t - knots[: -k - 1]) / np.where(left > 0, left, 1), 0.0)
        fall = np.where(right > 0, (knots[k + 1 :] - t) / np.where(right > 0, right, 1), 0.0)
        b = rise * b[:, :-1] + fall * b[:, 1:]
    return b


def interpolated(x: np.ndarray, t0: float, dt: float, rate: float, start: float | None = None, npts: int | None = None, method: str = "weighted_average_slopes", half: int = 20) -> tuple[np.ndarray, float]:
    """Samples at another rate, from ``start`` (t0) to the end or for ``npts``; and the new t0."""
    start = t0 if start is None else start
    last = t0 + (len(x) - 1) * dt
    n = npts or int(np.floor((last - start) * rate + 1e-9)) + 1
    t = start + np.arange(n) / rate
    if start < t0 - 1e-9 * dt or (len(t) and t[-1] > last + 1e-6 * dt):
        raise ValueError("the new grid leaves the series")
    s = np.clip((t - t0) / dt, 0, len(x) - 1)
    if method in ("linear", "slinear"):
        return np.interp(s, np.arange(len(x)), x), start
    if method == "nearest":
        return x[np.minimum(np.floor(s + 0.5).astype(int), len(x) - 1)], start
    if method == "zero":
        return x[np.floor(s + 1e-9).astype(int)], start
    if method == "lanczos":
        k = np.floor(s).astype(int)[:, None] + np.arange(-half + 1, half + 1)
        d = s[:, None] - k
        w = np.where(np.abs(d) < half, np.sinc(d) * np.sinc(d / half), 0) * ((k >= 0) & (k < len(x)))
        return (w * x[np.clip(k, 0, len(x) - 1)]).sum(1), start
    if method == "weighted_average_slopes":
        return hermite(x, s, wiggins_slopes(x)), start
    if method == "cubic":
        return hermite(x, s, spline_slopes(x)), start
    if method == "quadratic":
        return quadratic_spline(np.asarray(x, float), s), start
    raise ValueError(f"unknown method {method}")


def quadratic_spline(x: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The quadratic spline through all samples at places ``s`` (in samples): knots half way between
    samples, but for the first and last such place."""
    n = len(x)
    if n < 3:
        return np.interp(s, np.arange(n), x)
    knots = np.r_[np.zeros(3), np.arange(1.5, n - 2), np.full(3, n - 1.0)]

    def local(t):
        j = np.clip(np.searchsorted(knots, t, "right") - 1, 2, n - 1)
        a = (t - knots[j]) / (knots[j + 1] - knots[j])
        first = (knots[j + 1] - t) / (knots[j + 1] - knots[j - 1]) * (1 - a)
        last = (t - knots[j]) / (knots[j + 2] - knots[j]) * a
        return j, np.stack([first, 1 - first - last, last], 1)

    j, b = local(np.arange(n, dtype=float))
    band = np.zeros((n, 5))  # a sample's weights lie next to the diagonal
    for k in range(3):
        band[np.arange(n), np.clip(j - 2 + k - np.arange(n) + 2, 0, 4)] += b[:, k]
    below, middle, above, c = band[:, 1], band[:, 2].copy(), band[:, 3], x.copy()
    for i in range(1, n):
        f = below[i] / middle[i - 1]
        middle[i] -= f * above[i - 1]
        c[i] -= f * c[i - 1]
    c[-1] /= middle[-1]
    for i in range(n - 2, -1, -1):
        c[i] = (c[i] - above[i] * c[i + 1]) / middle[i]
    j, b = local(s)
    return sum(b[:, k] * c[j - 2 + k] for k in range(3))


def wiggins_slopes(x: np.ndarray) -> np.ndarray:
    """Slopes at the samples as averages of those beside them, the flatter one weighing more."""
    m = np.diff(x)
    if not len(m):
        return np.zeros(len(x))
    w = 1 / np.maximum(np.abs(m), 1e-12)
    inner = (w[:-1] * m[:-1] + w[1:] * m[1:]) / (w[:-1] + w[1:])
    inner = np.where(m[:-1] * m[1:] <= 0, 0.0, inner)
    return np.r_[m[0], inner, m[-1]]


def spline_slopes(x: np.ndarray) -> np.ndarray:
    """Slopes of the natural cubic spline (a tridiagonal system)."""
    n = len(x)
    if n < 3:
        return np.full(n, x[-1] - x[0] if n > 1 else 0.0)
    diag = np.r_[2.0, np.full(n - 2, 4.0), 2.0]
    rhs = 3 * np.r_[x[1] - x[0], x[2:] - x[:-2], x[-1] - x[-2]]
    for i in range(1, n):
        f = 1 / diag[i - 1]
        diag[i] -= f
        rhs[i] -= f * rhs[i - 1]
    rhs[-1] /= diag[-1]
    for i in range(n - 2, -1, -1):
        rhs[i] = (rhs[i] - rhs[i + 1]) / diag[i]
    return rhs


def hermite(x: np.ndarray, s: np.ndarray, slopes: np.ndarray) -> np.ndarray:
    k = np.minimum(np.floor(s).astype(int), max(len(x) - 2, 0))
    u = s - k
    a, b, da, db = x[k], x[np.minimum(k + 1, len(x) - 1)], slopes[k], slopes[np.minimum(k + 1, len(x) - 1)]
    return a * (2 * u**3 - 3 * u**2 + 1) + b * (3 * u**2 - 2 * u**3) + da * (u**3 - 2 * u**2 + u) + db * (u**3 - u**2)


def fft_resampled(x: np.ndarray, dt: float, rate: float) -> np.ndarray:
    """Fourier resampling to int(span * rate) samples."""
    n = int(len(x) * dt * rate + 1e-9)
    if n < 1:
        raise ValueError("nothing is left")
    spectrum = np.fft.rfft(x)
    m = min(n, len(x))
    out = np.zeros(n // 2 + 1, complex)
    keep = m // 2 + 1
    out[:keep] = spectrum[:keep]
    if m % 2 == 0 and n != len(x):  # the shared Nyquist bin
        out[m // 2] *= 0.5 if n > len(x) else 1.0
        if n < len(x):
            out[m // 2] = spectrum[m // 2].real * 2 if m // 2 < len(spectrum) - (len(x) % 2 == 0) else spectrum[m // 2]
    return np.fft.irfft(out, n) * (n / len(x))


def decimated(x: np.ndarray, factor: int, order: int = 8, zerophase: bool = True) -> np.ndarray:
    """Every ``factor``-th sample after a low pass at 0.8 of the new Nyquist frequency."""
    if factor < 1 or factor >= len(x):
        raise ValueError("the factor does not fit the series")
    if factor == 1:
        return np.asarray(x, float)
    return filtered(x, 1.0, "lowpass", [0.4 / factor], order, zerophase)[::factor]


# correlation -------------------------------------------------------------------------------------


def cross_correlation(a: np.ndarray, b: np.ndarray, shift: int, demean: bool = True, normalize: bool = True) -> np.ndarray:
    """Correlation at lags -shift .. shift (2 * shift + 1 values), the centre being lag 0 of the two
    arrays' middles."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    if demean:
        a, b = a - a.mean(), b - b.mean()
    n = len(a) + len(b) - 1
    size = 1 << (n - 1).bit_length()
    full = np.fft.irfft(np.fft.rfft(a, size) * np.conj(np.fft.rfft(b, size)), size)
    lags = np.arange(-shift, shift + 1) + (len(a) - len(b)) // 2
    out = np.where((lags > -len(b)) & (lags < len(a)), full[lags % size], 0.0)
    if normalize:
        scale = np.sqrt((a @ a) * (b @ b))
        out = out / scale if scale > 0 else np.zeros_like(out)
    return out


def xcorr_max(c: np.ndarray, absolute: bool = True) -> tuple[int, float]:
    """Shift from the centre and value of the (absolute) maximum."""
    k = int(np.argmax(np.abs(c) if absolute else c))
    return k - (len(c) - 1) // 2, float(c[k])


def template_correlation(x: np.ndarray, template: np.ndarray, normalize: bool = True) -> np.ndarray:
    """Correlation of a demeaned template with every full window of the series; normalized by the
    window's own norm about its mean."""
    t = np.asarray(template, float) - np.mean(template)
    n = len(t)
    dots = np.convolve(x, t[::-1], "valid")
    if not normalize:
        return dots
    s1, s2 = np.r_[0.0, np.cumsum(x)], np.r_[0.0, np.cumsum(np.square(x))]
    power = (s2[n:] - s2[:-n]) - (s1[n:] - s1[:-n]) ** 2 / n
    scale = np.sqrt(np.maximum(power, 0) * (t @ t))
    return np.where(scale > 1e-12 * max(1.0, float(np.max(np.abs(dots), initial=0.0))), dots / np.where(scale > 0, scale, 1), 0.0)


def detections(similarity: np.ndarray, height: float, distance: int) -> list[tuple[int, float]]:
    """Local maxima of at least ``height``, the higher first, none within ``distance`` of a kept one."""
    found = [i for i in np.argsort(-similarity, kind="stable") if similarity[i] >= height]
    kept: list[int] = []
    for i in found:
        if all(abs(i - k) >= distance for k in kept):
            kept.append(int(i))
    return [(k, float(similarity[k])) for k in sorted(kept)]


def sparse_convolve(times: np.ndarray, amplitudes: np.ndarray, wavelet: np.ndarray, n: int) -> np.ndarray:
    """Convolution of a wavelet with spikes at sample numbers."""
    out = np.zeros(n)
    for t, a in zip(np.asarray(times, int), amplitudes, strict=True):
        end = min(n, t + len(wavelet))
        if 0 <= t < n:
            out[t:end] += a * wavelet[: end - t]
    return out


# stacking and alignment of a group -----------------------------------------------------------------


def dbxcor_weights(members: np.ndarray, stack: np.ndarray, live: np.ndarray, floor: float = 1e-16) -> np.ndarray:
    """Weights against a stack, at most 1; -1 for the dead, 0 for members without length."""
    unit = stack / max(np.linalg.norm(stack), 1e-300)
    norms = np.linalg.norm(members, axis=1)
    along = members @ unit
    rest = np.linalg.norm(members - along[:, None] * unit, axis=1)
    w = np.where(norms > 0, np.abs(along) / (np.maximum(rest, floor * np.maximum(norms, 1e-300)) * np.maximum(norms, 1e-300)), 0.0)
    w[~live] = 0.0
    w = w / w.max() if w.max() > 0 else w
    return np.where(live, w, -1.0)


def robust_stack(members: np.ndarray, live: np.ndarray, method: str = "dbxcor", eps: float = 1e-3, most: int = 20) -> tuple[np.ndarray, np.ndarray, int]:
    """Stack, weights, rounds: the median, or weights against the stack until it moves by less than
    eps of its norm."""
    alive = members[live]
    stack = np.median(alive, axis=0) if len(alive) else np.zeros(members.shape[1])
    weights = np.where(live, 1.0, -1.0)
    if method == "median" or not len(alive):
        return stack, weights, 0
    for k in range(1, most + 1):
        weights = dbxcor_weights(members, stack, live)
        used = np.maximum(weights, 0)
        new = (used @ members) / used.sum() if used.sum() > 0 else stack
        moved = np.linalg.norm(new - stack) / max(np.linalg.norm(stack), 1e-300)
        stack = new
        if moved < eps:
            break
    return stack, weights, k


def shifted(x: np.ndarray, lag: int) -> np.ndarray:
    """The series read ``lag`` samples later, zeros where it has none."""
    out = np.zeros_like(x)
    if lag >= 0:
        out[: max(len(x) - lag, 0)] = x[lag:]
    else:
        out[-lag:] = x[:lag]
    return out


def align_and_stack(members: np.ndarray, live: np.ndarray, beam: np.ndarray, most_lag: int, window: tuple[int, int], eps: float = 1e-3, most: int = 20, remove_mean: bool = True) -> dict:
    """Align members to a beam by correlation inside a window, stack, repeat until the beam stays.
    Lags are clamped to +-most_lag. Lags, weights, the stack, and whether it converged."""
    a, b = window
    lags, weights, converged = np.zeros(len(members), int), np.where(live, 1.0, -1.0), False
    for _ in range(most):
        for i, x in enumerate(members):
            if live[i]:
                c = cross_correlation(x, np.r_[np.zeros(a), beam[a : b + 1], np.zeros(len(beam) - b - 1)], most_lag, demean=False)
                lags[i] = int(np.clip(xcorr_max(c, False)[0], -most_lag, most_lag))
        aligned = np.array([shifted(x, k) for x, k in zip(members, lags, strict=True)])
        new, weights, _ = robust_stack(aligned, live)
        moved = np.linalg.norm(new - beam) / max(np.linalg.norm(beam), 1e-300)
        beam = new
        if moved < eps:
            converged = True
            break
    mean = int(np.round(lags[live].mean())) if remove_mean and live.any() else 0
    return {"lags": lags - mean, "weights": weights, "stack": beam, "converged": converged}


def coda_end(envelope: np.ndarray, level: float, start: int) -> int:
    """The last sample from ``start`` before which the envelope stays at the level or above; start if none."""
    above = np.flatnonzero(envelope[start:] >= level)
    return start + int(above[-1]) if len(above) else start


def envelope(x: np.ndarray) -> np.ndarray:
    """Length of the analytic signal."""
    n = len(x)
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.abs(np.fft.ifft(np.fft.fft(x) * h))


# routing, more filters, and correlation of several channels ----------------------------------------


def chebyshev2(order: int, corner: float, rate: float, attenuation: float = 60.0) -> np.ndarray:
    """Sections of a Chebyshev type II low pass whose stop band starts at the corner."""
    if not 0 < corner < rate / 2 or order < 1:
        raise ValueError("the corner must be above zero and below the Nyquist frequency")
    mu = np.arcsinh(np.sqrt(10 ** (attenuation / 10) - 1)) / order
    m = np.arange(-order + 1, order, 2)
    upper = m[m != 0]
    zeros = 1j / np.sin(upper * np.pi / (2 * order))
    poles = -np.exp(1j * np.pi * m / (2 * order))
    poles = 1 / (np.sinh(mu) * poles.real + 1j * np.cosh(mu) * poles.imag)
    warped = 4 * np.tan(np.pi * corner / rate)
    gain = np.real(np.prod(-poles) / np.prod(-zeros)) * warped ** (len(poles) - len(zeros))
    zeros, poles = zeros * warped, poles * warped
    gain = gain * np.real(np.prod(4 - zeros) / np.prod(4 - poles))
    return sections(np.r_[(4 + zeros) / (4 - zeros), -np.ones(len(poles) - len(zeros))], (4 + poles) / (4 - poles), gain)


def resampled(x: np.ndarray, dt: float, rate: float) -> np.ndarray:
    """At another rate: decimated by a whole factor, else by Fourier resampling."""
    ratio = 1 / dt / rate
    whole = int(np.floor(ratio + 1e-9))
    if np.isclose(ratio, 1.0):
        return np.asarray(x, float)
    return decimated(x, whole) if ratio > 1 and np.isclose(ratio, whole) else fft_resampled(x, dt, rate)


def stream_similarity(channels: np.ndarray, templates: np.ndarray) -> np.ndarray:
    """Mean template correlation over the channels of a station set."""
    return np.mean([template_correlation(c, t) for c, t in zip(channels, templates, strict=True)], axis=0)


def best_template(channels: np.ndarray, templates: list[np.ndarray], at: int) -> tuple[int, float]:
    """The template that is most similar at a sample, and its similarity; ties go to the first."""
    values = [float(stream_similarity(channels, t)[at]) if at <= channels.shape[1] - t.shape[1] else -1.0 for t in templates]
    best = int(np.argmax(values))
    return best, values[best]


def xcorr_3c(a: np.ndarray, b: np.ndarray, shift: int, absolute: bool = False) -> tuple[int, float, np.ndarray]:
    """Shift and value of the maximum of the mean correlation over the components, and the function."""
    full = np.mean([cross_correlation(x, y, shift) for x, y in zip(a, b, strict=True)], axis=0)
    return *xcorr_max(full, absolute), full


def pick_correction(a: np.ndarray, b: np.ndarray, dt: float, pick_a: float, pick_b: float, before: float, after: float, most: float) -> tuple[float, float]:
    """Seconds to add to the second pick, from a parabola through the top of the correlation of the
    windows about both picks; and the correlation there. Picks are seconds from the first sample."""
    cut = lambda x, p: x[int(round((p - before) / dt)) : int(round((p + after) / dt)) + 1]
    u, v = cut(a, pick_a), cut(b, pick_b)
    if len(u) != len(v) or len(u) < 3:
        raise ValueError("the windows leave the series")
    c = cross_correlation(u, v, int(round(most / dt)))
    k, value = xcorr_max(c, False)
    i = k + (len(c) - 1) // 2
    if 0 < i < len(c) - 1:
        left, top, right = c[i - 1], c[i], c[i + 1]
        bend = left - 2 * top + right
        off = 0.5 * (left - right) / bend if bend < 0 else 0.0
        return -(k + off) * dt, float(top - 0.25 * (left - right) * off)
    return -k * dt, value
