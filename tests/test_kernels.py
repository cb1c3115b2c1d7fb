"""Numeric kernels against plain NumPy and analytic identities."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quakeframe.functions import decon, signal, spectral
from quakeframe.operators import window

RNG = np.random.default_rng(0)


def response(sos, f, rate):
    z = np.exp(-2j * np.pi * f / rate)
    h = np.ones_like(z)
    for b0, b1, b2, a0, a1, a2 in sos:
        h = h * (b0 + b1 * z + b2 * z**2) / (a0 + a1 * z + a2 * z**2)
    return np.abs(h)


@pytest.mark.parametrize("kind,corners", [("lowpass", [5.0]), ("highpass", [5.0]), ("bandpass", [3.0, 12.0]), ("bandstop", [3.0, 12.0])])
@pytest.mark.parametrize("order", [1, 2, 3, 4, 5])
def test_butterworth_magnitude(kind, corners, order):
    rate = 50.0
    sos = signal.butterworth(order, corners, kind, rate)
    f = np.linspace(0.05, 24.9, 400)
    w = np.tan(np.pi * f / rate)
    c = np.tan(np.pi * np.array(corners) / rate)
    if kind == "lowpass":
        x = w / c[0]
    elif kind == "highpass":
        x = c[0] / w
    else:
        x = (w**2 - c[0] * c[1]) / (w * (c[1] - c[0]))
        x = 1 / x if kind == "bandstop" else x
    assert np.allclose(response(sos, f, rate), 1 / np.sqrt(1 + x ** (2 * order)), atol=1e-7)


def test_sections_equal_the_recursion():
    sos = signal.butterworth(3, [2.0, 8.0], "bandpass", 40.0)
    x = RNG.normal(size=333)
    y = x.copy()
    for b0, b1, b2, _, a1, a2 in sos:
        out = np.zeros_like(y)
        for i in range(len(y)):
            g = lambda v, k: v[i - k] if i >= k else 0.0
            out[i] = b0 * y[i] + b1 * g(y, 1) + b2 * g(y, 2) - a1 * g(out, 1) - a2 * g(out, 2)
        y = out
    assert np.allclose(signal.run_sections(sos, x), y)


def test_filters_refuse_bad_corners():
    for corners, kind in (([0.0], "lowpass"), ([30.0], "lowpass"), ([8.0, 2.0], "bandpass")):
        with pytest.raises(ValueError):
            signal.butterworth(2, corners, kind, 40.0)


@given(st.integers(8, 120), st.integers(1, 40))
@settings(deadline=None)
def test_resampling_keeps_band_limited_signals(n, up):
    t = np.arange(n) / n
    x = np.cos(2 * np.pi * 2 * t) + 0.5 * np.sin(2 * np.pi * t)
    y = signal.fft_resampled(x, 1.0, (n + up) / n)
    u = np.arange(len(y)) / len(y)
    assert np.allclose(y, np.cos(2 * np.pi * 2 * u) + 0.5 * np.sin(2 * np.pi * u), atol=1e-8)


def test_interpolation_on_the_grid_is_the_series():
    x = RNG.normal(size=40)
    for method in ("linear", "nearest", "zero", "lanczos", "weighted_average_slopes", "cubic"):
        y, t0 = signal.interpolated(x, 5.0, 0.1, 10.0, method=method)
        assert t0 == 5.0 and np.allclose(y, x, atol=1e-9), method
    line = np.arange(30.0)
    for method in ("linear", "weighted_average_slopes", "cubic"):
        assert np.allclose(signal.interpolated(line, 0.0, 1.0, 4.0, method=method)[0], np.arange(117) / 4)
    with pytest.raises(ValueError):
        signal.interpolated(x, 0.0, 0.1, 10.0, start=-1.0)


def test_detrend():
    i = np.arange(50.0)
    assert np.allclose(signal.detrended(3 * i + 2, "linear"), 0) and np.allclose(signal.detrended(3 * i + 2, "simple"), 0)
    assert np.allclose(signal.detrended(i**3 - i, "polynomial", 3), 0, atol=1e-7) and abs(signal.detrended(i, "constant").mean()) < 1e-12


@given(st.integers(2, 40), st.integers(0, 12))
@settings(deadline=None)
def test_cross_correlation_equals_sums(n, shift):
    rng = np.random.default_rng(n)
    a, b = rng.normal(size=n), rng.normal(size=n)
    got = signal.cross_correlation(a, b, shift, False, False)
    want = [sum(a[i + k] * b[i] for i in range(n) if 0 <= i + k < n) for k in range(-shift, shift + 1)]
    assert np.allclose(got, want)


def test_template_and_detections():
    x = 0.01 * RNG.normal(size=300)
    w = np.hanning(20) * np.sin(np.arange(20))
    for at in (50, 200):
        x[at : at + 20] += w
    c = signal.template_correlation(x, w)
    assert [k for k, _ in signal.detections(c, 0.9, 10)] == [50, 200]
    s = x[100:120] - x[100:120].mean()
    t = w - w.mean()
    assert c[100] == pytest.approx(s @ t / np.sqrt((s @ s) * (t @ t)))


@pytest.mark.parametrize("n", [64, 600])
def test_tapers_are_orthonormal_and_concentrated(n):
    v = spectral.dpss(n, 2.5, 4)
    assert np.allclose(v @ v.T, np.eye(4), atol=1e-6)
    power = np.abs(np.fft.fft(v, 64 * n)) ** 2
    inside = power[:, : int(2.5 * 64) + 1].sum(1) + power[:, -int(2.5 * 64) :].sum(1)
    assert (inside / power.sum(1) > [0.99, 0.99, 0.98, 0.9]).all()


def test_spectrum_keeps_power_and_finds_lines():
    x = np.sin(2 * np.pi * 5 * np.arange(400) * 0.02)
    s = spectral.multitaper_spectrum(x, 0.02)
    assert s["spectrum"].sum() * s["df"] == pytest.approx(np.mean(x * x))
    assert abs(np.argmax(s["spectrum"]) * s["df"] - 5) < 0.3


def test_bandwidth_edges():
    s, n = np.ones(101), np.ones(101)
    s[20:61] = 100
    b = spectral.bandwidth(s, n, 0.1, 3.0, 4.0)
    assert (b["low"], b["high"]) == (pytest.approx(2.0), pytest.approx(6.0))
    assert spectral.bandwidth(n, n, 0.1, 3.0)["high"] == 0.0
    assert spectral.bandwidth(s, n * 0, 0.1, 3.0)["low_snr"] > 1e5


def test_deconvolution_recovers_spikes():
    w = np.exp(-0.5 * (np.arange(12) - 2) ** 2 / 2)
    data = signal.sparse_convolve(np.array([10, 40]), np.array([1.0, -0.5]), w, 128)
    noise = 1e-4 * RNG.normal(size=128)
    for method in decon.METHODS:
        options = {"level": 1e-3} if method == "WaterLevel" else {"damping": 1e-4} if "Least" in method else {}
        rf = decon.deconvolve(method, data, w, 0.1, noise, **options)
        assert int(np.argmax(rf)) == 10, method
        if method != "MultiTaperXcor":  # its tapers weigh the two spikes by their place in the window
            assert int(np.argmin(rf)) == 40, method
    out = decon.iterative(np.array([data, 0.5 * data, 0 * data]), w, 0.1, stop=1e-8, inverse="matched")
    assert out["lags"].tolist() == [10, 40] and np.allclose(out["amplitudes"], [[1, 0.5, 0], [-0.5, -0.25, 0]], atol=1e-6)
    with pytest.raises(ValueError):
        decon.water_level(np.array([np.nan]), w, 0.1)
    with pytest.raises(ValueError):
        decon.deconvolve("MultiTaperXcor", data, w, 0.1)


def test_robust_stack_downweights_noise():
    s = np.sin(np.arange(80) / 4)
    members = np.array([s + 0.05 * RNG.normal(size=80) for _ in range(9)] + [5 * RNG.normal(size=80)])
    stack, weights, rounds = signal.robust_stack(members, np.ones(10, bool))
    assert weights[-1] < 0.2 * weights[:-1].min() and np.corrcoef(stack, s)[0, 1] > 0.999 and 1 <= rounds <= 20
    live = np.array([True] * 9 + [False])
    assert signal.robust_stack(members, live)[1][-1] == -1


def test_alignment_finds_the_lags():
    w = np.exp(-0.5 * (np.arange(100) - 50) ** 2 / 9)
    true = np.array([0, 3, -4, 2])
    members = np.array([np.roll(w, k) for k in true])
    out = signal.align_and_stack(members, np.ones(4, bool), w, 8, (30, 70), remove_mean=False)
    assert out["lags"].tolist() == true.tolist() and out["converged"]


def test_gain():
    x = RNG.normal(size=50)
    g = window.agc_rms(x, 3)
    assert g[10] == pytest.approx(np.sqrt(np.mean(x[7:14] ** 2))) and g[0] == pytest.approx(np.sqrt(np.mean(x[:4] ** 2)))


def test_arrival_metrics():
    from quakeframe.functions import qc

    x = 0.1 * RNG.normal(size=4000)
    x[2000:2600] += np.sin(2 * np.pi * 2.0 * np.arange(600) * 0.05)
    out = qc.arrival_snr(x, 0.0, 0.05, 100.0, (-90.0, -5.0), (0.0, 30.0))
    assert out["low_f_band_edge"] <= 2.0 <= out["high_f_band_edge"] and out["snr_filtered_L2"] > 3
    three = np.array([0.1 * RNG.normal(size=4000), 0.1 * RNG.normal(size=4000), x])
    assert qc.broadband_snr(three, 0.0, 0.05, 100.0, noise=(-90.0, -5.0), signal=(0.0, 30.0))["snr_3c_peak"] > 4
    with pytest.raises(ValueError):
        qc.arrival_snr(x, 0.0, 0.05, 1e6)
    with pytest.raises(ValueError):
        qc.filter_by_band(x, 0.05, 3.0, 2.0)
    gathered = qc.prepared_gather(np.array([x, np.roll(x, 20), x]), np.zeros(3), 0.05, np.array([100.0, 101.0, np.nan]), np.array([5.0, 9.0, 99.0]), corners=(1.0, 4.0))
    assert gathered["live"].tolist() == [True, True, False] and gathered["beam"] == 1
    assert 20 < gathered["window_end"] < 60 and np.allclose(gathered["t0"][:2], [-100, -101])
    assert qc.median_band([(1, 2), (0, 0), (3, 6)]) == (2.0, 4.0, 2) and qc.median_band([]) == (0.0, 0.0, 0)


def test_common_sum():
    from quakeframe.functions.kernels import common_sum

    a = np.ones(4)
    assert common_sum(a, np.array([1.0, 2.0]), 3).tolist() == [1, 1, 1, 2]
    assert common_sum(a, np.array([1.0, 2.0]), -1).tolist() == [3, 1, 1, 1] and common_sum(a, a, 9).tolist() == [1] * 4


@pytest.mark.parametrize("order", [2, 3, 6])
def test_chebyshev_stop_band(order):
    sos = signal.chebyshev2(order, 10.0, 50.0, 40.0)
    f = np.linspace(10.0, 24.9, 300)
    assert response(sos, f, 50.0).max() <= 0.01 + 1e-9 and response(sos, np.array([0.0]), 50.0)[0] == pytest.approx(1)
    assert response(sos, np.array([10.0]), 50.0)[0] == pytest.approx(0.01)


def test_resample_routes():
    t = np.arange(400) * 0.05
    x = np.sin(2 * np.pi * 0.5 * t)
    assert len(signal.resampled(x, 0.05, 5.0)) == 100 and len(signal.resampled(x, 0.05, 7.0)) == 140
    assert np.allclose(signal.resampled(x, 0.05, 20.0), x)


def test_several_channels():
    w = np.hanning(30) * np.sin(np.arange(30) / 2)
    x = np.array([np.r_[np.zeros(40), k * w, np.zeros(50)] for k in (1.0, 2.0)]) + 1e-3 * RNG.normal(size=(2, 120))
    assert int(np.argmax(signal.stream_similarity(x, np.array([w, w])))) == 40
    assert signal.best_template(x, [np.array([w[::-1], w]), np.array([w, w])], 40)[0] == 1
    lag, value, _ = signal.xcorr_3c(x, np.roll(x, -3, axis=1), 10)
    assert lag == 3 and value > 0.99
    t = np.arange(400) * 0.01
    a, b = (np.exp(-((t - c) ** 2) / 0.005) for c in (1.5, 1.537))
    off, top = signal.pick_correction(a, b, 0.01, 1.5, 1.5, 0.5, 0.6, 0.2)
    assert off == pytest.approx(0.037, abs=2e-3) and top > 0.99


def test_spline_detrend_and_annotations():
    from quakeframe.functions import qc

    i = np.arange(200.0)
    b = signal.spline_basis(200, 40)
    assert np.allclose(b.sum(1), 1) and np.allclose(signal.detrended(1e-4 * i**3 - i, "spline", 40), 0, atol=1e-6)
    assert qc.annotations(np.array([0.1, 0.6, 0.9]), 10.0, 0.5, 0.6, (10.0, 10.9)) == {"10.5": 0.6}
