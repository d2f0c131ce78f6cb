"""Filters, spectra and levels of tones."""

import numpy as np

from earshot.operators import dsp

T = np.arange(dsp.RATE) / dsp.RATE


def tone(hz, amp=0.1):
    return amp * np.sin(2 * np.pi * hz * T)


def test_filter_equals_recursion():
    rng = np.random.default_rng(1)
    sos, x = dsp.highpass(4, 80.0, dsp.RATE), rng.standard_normal(1000)
    y = x.copy()
    for b0, b1, b2, _, a1, a2 in sos:
        z0 = z1 = 0.0
        out = np.empty_like(y)
        for i, v in enumerate(y):
            out[i] = b0 * v + z0
            z0, z1 = b1 * v - a1 * out[i] + z1, b2 * v - a2 * out[i]
        y = out
    whole, _ = dsp.run_filter(sos, x)
    first, state = dsp.run_filter(sos, x[:333])
    second, _ = dsp.run_filter(sos, x[333:], state)
    assert np.allclose(whole, y, atol=1e-9) and np.allclose(np.concatenate((first, second)), y, atol=1e-9)


def test_responses():
    a = 20 * np.log10(np.abs(dsp.response(dsp.a_weighting(dsp.RATE), np.array([1000.0, 100.0, 4000.0]), dsp.RATE)))
    assert abs(a[0]) < 0.03 and abs(a[1] + 19.1) < 0.3 and abs(a[2] - 1.0) < 0.4
    h = 20 * np.log10(np.abs(dsp.response(dsp.highpass(4, 80.0, dsp.RATE), np.array([80.0, 1000.0]), dsp.RATE)))
    assert abs(h[0] + 3.01) < 0.05 and abs(h[1]) < 0.01
    y, _ = dsp.run_filter(dsp.highpass(4, 80.0, dsp.RATE), np.ones(2000), dsp.settle(dsp.highpass(4, 80.0, dsp.RATE)))
    assert np.abs(y).max() < 1e-6


def test_curve_up_to_the_highest_band():
    """The standard's A curve in dB; warped corners keep it near half the rate, where the digital filter falls off faster."""
    hz = np.array([31.5, 100.0, 1000.0, 4000.0, 8000.0, 12500.0, 16000.0])
    a = 20 * np.log10(np.abs(dsp.response(dsp.a_weighting(dsp.RATE), hz, dsp.RATE)))
    w = 2 * dsp.RATE * np.tan(np.pi * hz / dsp.RATE)
    c = [2 * dsp.RATE * np.tan(np.pi * f / dsp.RATE) for f in dsp.CORNERS]
    want = 20 * np.log10(c[3] ** 2 * w**4 / ((w**2 + c[0] ** 2) * np.sqrt((w**2 + c[1] ** 2) * (w**2 + c[2] ** 2)) * (w**2 + c[3] ** 2))) + 1.9997
    assert np.allclose(a, want, atol=1e-9) and np.all(np.abs(a[:4] - [-39.4, -19.1, 0.0, 1.0]) < 0.4)


def test_filter_starts_from_the_first_sample():
    """A constant is silent to the A curve from the first sample on; without that it would ring."""
    levels, _ = dsp.loudness(np.full(4800, 0.3), None)
    assert levels["dBA_spl"] < 0 and levels["LAFmax_dB"] < 0
    assert dsp.loudness(np.zeros(0), None)[0]["dBA_spl"] == -120.0


def test_spectrum_by_its_definitions():
    """Levels, shares, centroid, rolloff and peaks of noise and tones, band by band and bin by bin."""
    rng = np.random.default_rng(3)
    for x in (rng.standard_normal(4801) / 9, tone(440.0)[:30000] + tone(460.0, 0.02)[:30000] + tone(5000.0, 0.05)[:30000], np.zeros(500), np.ones(2)):
        hz, power = dsp.welch(x)
        got = dsp.spectrum(x)
        for side, p in (("z", power), ("a", power * np.abs(dsp.response(dsp.a_weighting(dsp.RATE), hz, dsp.RATE)) ** 2)):
            area = lambda low, high, p=p: sum((p[k] + p[k + 1]) / 2 * (hz[k + 1] - hz[k]) for k in range(len(hz) - 1) if hz[k] >= low and hz[k + 1] <= high)
            db = lambda v: 10 * np.log10(max(v, 1e-20))
            assert np.allclose(got[side]["levels_db"], [db(area(c / 2 ** (1 / 6), c * 2 ** (1 / 6))) for c in dsp.CENTRES], atol=0.051)
            parts = [area(*b) for b in (dsp.LOW, dsp.MID, dsp.HIGH)]
            assert np.allclose(list(got[side]["energy_pct"].values()), [100 * v / sum(parts) if sum(parts) > 1e-20 else 0 for v in parts], atol=0.051)
            inside = (hz >= 31.5) & (hz <= 16000)
            f, q = hz[inside], p[inside]
            some = q.sum() > 1e-20
            assert abs(got[side]["centroid_hz"] - ((f * q).sum() / q.sum() if some else 0)) < 0.06
            assert abs(got[side]["rolloff_85_hz"] - (next(f[k] for k in range(len(f)) if q[: k + 1].sum() >= 0.85 * q.sum()) if some else 0)) < 0.06
            at = [v["hz"] for v in got[side]["peaks"]]
            assert len(at) <= 3 and all(abs(a - b) >= 0.1155 * min(a, b) - 0.1 for k, a in enumerate(at) for b in at[:k])
    assert [round(v["hz"], -2) for v in dsp.spectrum(tone(440.0) + tone(5000.0, 0.05))["z"]["peaks"]][:2] == [400.0, 5000.0]
    silent = dsp.spectrum(np.zeros(0))
    assert silent["z"] == silent["a"] and set(silent["z"]["levels_db"]) == {-200.0} and silent["z"]["peaks"] == []


def test_filter_states_in_any_number_of_tasks(spark):
    """One recording with offset and empty chunks, another beside it: levels are those of the sequential filter."""
    rng = np.random.default_rng(8)
    rows = [("d", "r", i, (0.2 + 0.1 * rng.standard_normal(rng.integers(0, 700))).tolist()) for i in range(40)] + [(None, None, i, rng.standard_normal(50).tolist()) for i in range(3)]
    pcm = spark.createDataFrame(rows, "device_id string, recording_id string, chunk_index int, pcm array<double>").repartition(7)
    got = {(r["device_id"], r["chunk_index"]): r for r in dsp.loudness_of(pcm).collect()}
    assert len(got) == len(rows)
    key, state = None, None
    for d, _, i, x in rows:
        if d != key:
            key, state = d, None
        if state is None and not x:
            continue
        want, state = dsp.loudness(np.array(x), state)
        assert all(abs(got[d, i][c] - v) < 1e-9 for c, v in want.items())
    sos = dsp.highpass(4, 80.0, dsp.RATE)
    states = dsp.with_filter_states(pcm.filter("device_id = 'd'"), sos, ["device_id"], "chunk_index").collect()
    state = None
    for r in sorted(states, key=lambda r: r["chunk_index"]):
        assert (r["state"] is None) == (state is None) and (state is None or np.allclose(np.array(r["state"]).reshape(-1, 2), state, atol=1e-12))
        x = np.array(r["pcm"])
        if len(x):
            _, state = dsp.run_filter(sos, x, dsp.settle(sos) * x[0] if state is None else state)


def test_blocks_of_maps_in_any_width(spark):
    """Composition over blocks equals one fold: affine maps of numbers, many keys."""
    from earshot.operators import scan

    rng = np.random.default_rng(2)
    rows = [(k, i * 3, [float(a), float(b)]) for k, n in (("a", 50), ("b", 1), ("", 13)) for i, (a, b) in enumerate(rng.integers(-2, 3, (n, 2)))]
    maps = spark.createDataFrame(rows, "key string, place long, map array<double>").repartition(5)
    for width, levels in ((4, 0), (4, 1), (3, 3), (1024, 1)):
        got = {(r["key"], r["place"]): r["state"] for r in scan.before(maps, ["key"], lambda a, b: np.array([a[0] * b[0], b[0] * a[1] + b[1]]), lambda s, m: np.array([m[0] * (1.0 if s is None else s[0]) + m[1]]), levels, width).collect()}
        states: dict = {}
        for k, place, (a, b) in rows:
            assert got[k, place] == states.get(k)
            states[k] = [a * states.get(k, [1.0])[0] + b]


def test_loudness_of_a_tone():
    levels, state = dsp.loudness(tone(1000.0), None)
    again, _ = dsp.loudness(tone(1000.0), state)
    want = 20 * np.log10(0.1 / np.sqrt(2)) + 120
    assert abs(again["dBA_spl"] - want) < 0.2 and abs(levels["LAFmax_dB"] - want) < 0.5


def test_spectrum_of_a_tone():
    s = dsp.spectrum(tone(1000.0))["z"]
    assert abs(s["peaks"][0]["hz"] - 1000.0) < 10 and abs(s["centroid_hz"] - 1000.0) < 20 and s["energy_pct"]["mid"] > 99
    assert int(np.argmax(s["levels_db"])) == dsp.CENTRES.index(1000.0)


def test_windows_and_resampling():
    loud = np.concatenate((np.zeros(9600), np.ones(9600) * 0.5, np.zeros(100)))
    assert abs(dsp.subwindow_peak_rms(loud) - 0.5) < 1e-9
    assert len(dsp.resample(tone(440.0), 1, 3)) == 16000
    x = dsp.resample(tone(440.0), 1, 3)
    assert abs(np.sqrt(np.mean(x[1000:-1000] ** 2)) - 0.1 / np.sqrt(2)) < 1e-3
    assert len(dsp.fit_window(np.ones(5), 12, True)) == 12 and dsp.fit_window(np.arange(9), 4, True).tolist() == [5, 6, 7, 8] and dsp.fit_window(np.arange(9), 4, False).tolist() == [0, 1, 2, 3]
    assert dsp.log_mel(tone(440.0)).shape == (101, 64)


def test_spark_functions(spark):
    pcm = spark.createDataFrame([("d", "r", i, i, tone(500.0 * (i + 1))[:9600].tolist()) for i in range(2)], "device_id string, recording_id string, chunk_index int, chunk_id long, pcm array<double>")
    assert dsp.loudness_of(pcm).count() == 2
    assert {r["chunk_id"]: round(r["z"]["peaks"][0]["hz"], -2) for r in dsp.spectra(pcm).collect()} == {0: 500.0, 1: 1000.0}
    ints = spark.createDataFrame([([8388608 * 128, -256],)], "x array<int>")
    assert ints.select(dsp.align(ints["x"])).first()[0] == [0.5, -1 / 8388608]
