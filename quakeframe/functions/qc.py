"""Quality control of records about an arrival, and the preparation of gathers for alignment."""

from __future__ import annotations

import numpy as np

from quakeframe.functions.arrays import NO_NOISE
from quakeframe.functions.signal import coda_end, envelope, filtered
from quakeframe.functions.spectral import fd_snr


def sample_range(t0: float, dt: float, n: int, start: float, end: float) -> tuple[int, int]:
    """First and last sample of a closed time range, inside the series."""
    a, b = int(np.floor((start - t0) / dt + 0.5)), int(np.floor((end - t0) / dt + 0.5))
    a, b = max(a, 0), min(b, n - 1)
    if b < a:
        raise ValueError("the window is outside the series")
    return a, b


def arrival_snr(x: np.ndarray, t0: float, dt: float, arrival: float, noise: tuple[float, float] = (-130.0, -5.0), signal: tuple[float, float] = (-5.0, 120.0), **options) -> dict:
    """The metrics of ``fd_snr`` in windows about an arrival, with the windows used."""
    ranges = [sample_range(t0, dt, len(x), arrival + a, arrival + b) for a, b in (noise, signal)]
    out = fd_snr(np.asarray(x, float), dt, ranges[0], ranges[1], **options)
    return out | {"noise_window_start": noise[0], "noise_window_end": noise[1], "signal_window_start": signal[0], "signal_window_end": signal[1], "phase_time": arrival}


def broadband_snr(components: np.ndarray, t0: float, dt: float, arrival: float, component: int = 2, **windows) -> dict:
    """The metrics of one of three components, and the ratios of vector lengths."""
    c = np.asarray(components, float)
    out = arrival_snr(c[component], t0, dt, arrival, **windows)
    noise, signal = windows.get("noise", (-130.0, -5.0)), windows.get("signal", (-5.0, 120.0))
    length = np.sqrt((c**2).sum(0))
    parts = [length[slice(a, b + 1)] for a, b in (sample_range(t0, dt, c.shape[1], arrival + w[0], arrival + w[1]) for w in (noise, signal))]
    peak, rms = parts[1].max(), np.sqrt(np.mean(parts[0] ** 2))
    out["snr_3c_peak"] = float(peak / rms) if rms > 0 else NO_NOISE if peak > 0 else -1.0
    return out


def filter_by_band(x: np.ndarray, dt: float, low: float, high: float, lowest: float = 0.02, npoles: int = 4) -> np.ndarray:
    """A low pass at the high edge if the low edge is below ``lowest``, else a band pass."""
    if not high > low >= 0:
        raise ValueError("no valid band")
    return filtered(x, dt, "lowpass", [high], npoles) if low < lowest else filtered(x, dt, "bandpass", [low, high], npoles)


def median_band(bands: list[tuple[float, float]]) -> tuple[float, float, int]:
    """Median edges of the bands that are valid, and their number; zeros without any."""
    good = [b for b in bands if b[1] > b[0]]
    return (float(np.median([b[0] for b in good])), float(np.median([b[1] for b in good])), len(good)) if good else (0.0, 0.0, 0)


def noise_amplitude(x: np.ndarray, metric: str = "rms") -> float:
    a = np.sort(np.abs(x))
    return {"rms": float(np.sqrt(np.mean(x**2))), "peak": float(a[-1]), "mad": float(a[min(len(a) // 2, len(a) - 1)])}[metric]


def prepared_gather(members: np.ndarray, t0: np.ndarray, dt: float, arrivals: np.ndarray, snr: np.ndarray, bands: list[tuple[float, float]] | None = None, corners: tuple[float, float] | None = None, noise: tuple[float, float] = (-60.0, -5.0), metric: str = "rms", level: float = 4.0, most_fraction: float = 0.5) -> dict:
    """A gather ready for alignment: members filtered in the given or the median band, start times
    relative to the arrival (no arrival: dead), coda durations against the noise, the correlation
    window's end, and the member with the best ratio as the first beam."""
    live = np.isfinite(arrivals) & np.isfinite(t0)
    low, high = corners if corners else median_band(bands or [])[:2]
    x = np.array([filter_by_band(m, dt, low, high) if a and high > low else m for m, a in zip(members, live, strict=True)])
    start = np.where(live, t0 - np.where(live, arrivals, 0), 0.0)
    coda, room = np.zeros(len(x)), np.zeros(len(x))
    for i in np.flatnonzero(live):
        try:
            a, b = sample_range(start[i], dt, x.shape[1], *noise)
        except ValueError:
            live[i] = False
            continue
        first = int(np.clip(np.floor(-start[i] / dt + 0.5), 0, x.shape[1] - 1))
        coda[i] = (coda_end(envelope(x[i]), level * noise_amplitude(x[i, a : b + 1], metric), first) - first) * dt
        room[i] = (x.shape[1] - 1 - first) * dt
    if not live.any():
        raise ValueError("no live member")
    end = float(min(np.median(coda[live]), most_fraction * room[live].min()))
    ratio = np.where(live & np.isfinite(snr), snr, -np.inf)
    return {"data": x, "t0": start, "live": live, "coda": coda, "window_start": 0.0, "window_end": end, "beam": int(np.argmax(ratio)), "low": low, "high": high}


def annotations(probability: np.ndarray, t0: float, dt: float, threshold: float, window: tuple[float, float] | None = None) -> dict[str, float]:
    """Times (as text) and probabilities of the samples that a picker gives at least the threshold,
    inside a closed time window if there is one. The picker is any function of a record."""
    p = np.asarray(probability, float)
    t = t0 + np.arange(len(p)) * dt
    hit = p >= threshold
    if window is not None:
        hit &= (t >= window[0]) & (t <= window[1])
    return {repr(float(a)): float(b) for a, b in zip(t[hit], p[hit], strict=True)}
