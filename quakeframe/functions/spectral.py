"""Multitaper spectra, bandwidth and signal-to-noise metrics. NumPy only."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from quakeframe.functions.arrays import NO_NOISE
from quakeframe.functions.signal import envelope, filtered


@lru_cache(maxsize=64)
def dpss(n: int, nw: float, k: int) -> np.ndarray:
    """The first k discrete prolate spheroidal sequences of length n: eigenvectors of the symmetric
    tridiagonal matrix that commutes with the concentration problem, found by bisection on its
    Sturm counts and inverse iteration. Unit energy; even ones with a positive mean."""
    i = np.arange(n, dtype=float)
    diag = ((n - 1 - 2 * i) / 2) ** 2 * np.cos(2 * np.pi * nw / n)
    off = i[1:] * (n - i[1:]) / 2
    if n <= 512:
        _, v = np.linalg.eigh(np.diag(diag) + np.diag(off, 1) + np.diag(off, -1))
        v = v[:, ::-1][:, :k].T
    else:
        v = np.array([_eigenvector(diag, off, _eigenvalue(diag, off, n - j), j) for j in range(k)])
    out = []
    for j, x in enumerate(v):
        if j % 2 == 0:
            x = x * np.sign(x.sum() or 1)
        else:
            x = x * np.sign((x * (n - 1 - 2 * i)).sum() or 1)
        out.append(x / np.linalg.norm(x))
    return np.array(out)


def _eigenvalue(d: np.ndarray, e: np.ndarray, rank: int) -> float:
    """The eigenvalue with ``rank`` eigenvalues up to and including it, by bisection."""
    radius = np.r_[0, np.abs(e)] + np.r_[np.abs(e), 0]
    low, high = float((d - radius).min()), float((d + radius).max())
    d, e2 = d.tolist(), (e * e).tolist()
    for _ in range(80):
        mid = (low + high) / 2
        q, below = d[0] - mid, 0
        below += q < 0
        for a, b in zip(d[1:], e2, strict=True):
            q = a - mid - b / (q if q else 1e-300)
            below += q < 0
        low, high = (low, mid) if below >= rank else (mid, high)
        if high - low <= 1e-13 * max(abs(low), abs(high), 1.0):
            break
    return (low + high) / 2


def _eigenvector(d: np.ndarray, e: np.ndarray, value: float, j: int) -> np.ndarray:
    """Inverse iteration on the shifted tridiagonal matrix."""
    n = len(d)
    x = np.cos(np.pi * j * (np.arange(n) + 0.5) / n)
    shift = d - value + 1e-10 * max(abs(value), 1.0)
    for _ in range(3):
        c, y = np.zeros(n), x.copy()
        b = shift.copy()
        for i in range(1, n):
            w = e[i - 1] / (b[i - 1] if b[i - 1] else 1e-300)
            b[i] -= w * e[i - 1]
            y[i] -= w * y[i - 1]
        c[-1] = y[-1] / (b[-1] if b[-1] else 1e-300)
        for i in range(n - 2, -1, -1):
            c[i] = (y[i] - e[i] * c[i + 1]) / (b[i] if b[i] else 1e-300)
        x = c / np.linalg.norm(c)
    return x


def multitaper_spectrum(x: np.ndarray, dt: float, nw: float = 2.5, k: int = 4, nfft: int | None = None) -> dict:
    """Mean of the tapered periodograms, scaled so that its sum times df is the mean square: df, f0, spectrum."""
    x = np.asarray(x, float)
    n = len(x)
    nfft = max(nfft or n, n)
    df = 1 / (nfft * dt)
    p = np.mean(np.abs(np.fft.rfft(x * dpss(n, nw, k), nfft)) ** 2, axis=0)
    p[1 : (nfft + 1) // 2] *= 2
    total, power = p.sum() * df, np.mean(x * x)
    return {"df": df, "f0": 0.0, "spectrum": p * (power / total) if total > 0 else p}


def smoothed(x: np.ndarray, width: int) -> np.ndarray:
    if width <= 1:
        return x
    total = np.convolve(x, np.ones(width), "same")
    return total / np.convolve(np.ones(len(x)), np.ones(width), "same")


def amplitude_ratio(signal: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Square root of the power ratio; the large constant over no noise, 0 without both."""
    return np.where(noise > 0, np.sqrt(signal / np.where(noise > 0, noise, 1)), np.where(signal > 0, NO_NOISE, 0.0))


def bandwidth(signal: np.ndarray, noise: np.ndarray, df: float, threshold: float = 1.5, start: float = 1.0, smoother: float = 0.0, highest: float | None = None) -> dict:
    """The band around a start frequency where signal over noise stays above the threshold.

    The search goes up and down from the start; if the start fails, from the best bin. The high
    edge is 0.8 of the highest frequency at most. Low, high, their ratios; zeros without a band.
    """
    r = amplitude_ratio(np.asarray(signal, float), np.asarray(noise, float))
    r = smoothed(r, int(round(smoother / df))) if smoother > 0 else r
    last = min(len(r) - 1, int((highest if highest is not None else 0.8 * df * (len(r) - 1)) / df))
    at = min(max(int(round(start / df)), 1), last)
    if r[at] < threshold:
        at = 1 + int(np.argmax(r[1 : last + 1])) if last >= 1 else 0
        if r[at] < threshold:
            return {"low": 0.0, "high": 0.0, "low_snr": 0.0, "high_snr": 0.0, "f_range": float(df * last)}
    low = high = at
    while low > 1 and r[low - 1] >= threshold:
        low -= 1
    while high < last and r[high + 1] >= threshold:
        high += 1
    return {"low": float(low * df), "high": float(high * df), "low_snr": float(r[low]), "high_snr": float(r[high]), "f_range": float(df * last)}


def bandwidth_statistics(signal: np.ndarray, noise: np.ndarray, df: float, low: float, high: float) -> dict:
    """Median, extremes, quartiles and mean of the ratio inside the band."""
    r = amplitude_ratio(np.asarray(signal, float), np.asarray(noise, float))[int(round(low / df)) : int(round(high / df)) + 1]
    if high <= low or not len(r):
        return dict.fromkeys(("median", "maximum", "minimum", "q1_4", "q3_4", "mean"), 0.0)
    return {"median": float(np.median(r)), "maximum": float(r.max()), "minimum": float(r.min()), "q1_4": float(np.quantile(r, 0.25)), "q3_4": float(np.quantile(r, 0.75)), "mean": float(r.mean())}


def fd_snr(x: np.ndarray, dt: float, noise: tuple[int, int], signal: tuple[int, int], nw: float = 2.5, k: int = 4, threshold: float = 1.5, npoles: int = 3, perc: float = 0.95) -> dict:
    """Band and in-band ratios of a signal range against a noise range [first, last] of samples."""
    n, s = x[noise[0] : noise[1] + 1], x[signal[0] : signal[1] + 1]
    nfft = max(len(n), len(s))
    ps, pn = multitaper_spectrum(s, dt, nw, k, nfft), multitaper_spectrum(n, dt, nw, k, nfft)
    band = bandwidth(ps["spectrum"], pn["spectrum"], ps["df"], threshold)
    out = {"low_f_band_edge": band["low"], "high_f_band_edge": band["high"], "low_f_band_edge_snr": band["low_snr"], "high_f_band_edge_snr": band["high_snr"]}
    out |= {f"snr_{k}": v for k, v in bandwidth_statistics(ps["spectrum"], pn["spectrum"], ps["df"], band["low"], band["high"]).items()}
    if band["high"] > band["low"]:
        y = filtered(x, dt, "bandpass", [band["low"], band["high"]], npoles) if band["low"] > 0.02 else filtered(x, dt, "lowpass", [band["high"]], npoles)
        fn, fs = y[noise[0] : noise[1] + 1], y[signal[0] : signal[1] + 1]
        ratio = lambda a, b: float(a / b) if b > 0 else NO_NOISE if a > 0 else -1.0
        at = lambda v: float(np.sort(np.abs(v))[min(int(perc * len(v)), len(v) - 1)])
        out |= {
            "snr_filtered_envelope_peak": ratio(envelope(fs).max(), envelope(fn).max()),
            "snr_filtered_L2": ratio(np.sqrt(np.mean(fs**2)), np.sqrt(np.mean(fn**2))),
            "snr_filtered_Linf": ratio(np.abs(fs).max(), np.abs(fn).max()),
            "snr_filtered_MAD": ratio(np.sort(np.abs(fs))[min(len(fs) // 2, len(fs) - 1)], np.sort(np.abs(fn))[min(len(fn) // 2, len(fn) - 1)]),
            "snr_filtered_perc": ratio(at(fs), at(fn)),
        }
    return out
