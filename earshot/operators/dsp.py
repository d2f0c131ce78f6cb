"""Signal processing in numpy, applied to arrays of samples by pandas functions.

Filters are second-order sections designed by the bilinear transform; no
package beyond numpy is needed.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan

RATE = 48_000
#: Third-octave centres in Hz, and the bounds of the energy regions.
CENTRES = (31.5, 40.0, 50.0, 63.0, 80.0, 100.0, 125.0, 160.0, 200.0, 250.0, 315.0, 400.0, 500.0, 630.0, 800.0, 1000.0, 1250.0, 1600.0, 2000.0, 2500.0, 3150.0, 4000.0, 5000.0, 6300.0, 8000.0, 10000.0, 12500.0, 16000.0)
LOW, MID, HIGH = (31.5, 500.0), (500.0, 2000.0), (2000.0, 16000.0)
SEGMENT = 16384
CALIBRATION = 120.0


def align(samples: Column) -> Column:
    """32-bit integers with 24 significant bits to floats of at most one."""
    return F.transform(samples, lambda x: F.shiftright(x, 8).cast("double") / F.lit(8388608.0))


def aligned(samples: np.ndarray) -> np.ndarray:
    """``align`` of an array."""
    return (samples.astype(np.int32) >> 8) / 8388608.0


def _pairs(roots: list[complex]) -> list[tuple[complex, complex]]:
    """Roots in conjugate or real pairs."""
    complex_ = [r for r in roots if r.imag > 1e-12]
    real = sorted((r.real for r in roots if abs(r.imag) <= 1e-12), reverse=True)
    out = [(r, r.conjugate()) for r in complex_]
    return out + [(complex(real[i]), complex(real[i + 1]) if i + 1 < len(real) else 0j) for i in range(0, len(real), 2)]


def sections(zeros: list[complex], poles: list[complex], gain: float) -> np.ndarray:
    """Second-order sections of a digital filter."""
    z, p = _pairs(zeros), _pairs(poles)
    z += [(0j, 0j)] * (len(p) - len(z))
    rows = [[1.0, -(a + b).real, (a * b).real, 1.0, -(c + d).real, (c * d).real] for (a, b), (c, d) in zip(z, p)]
    out = np.array(rows)
    out[0, :3] *= gain
    return out


def bilinear(zeros: list[complex], poles: list[complex], gain: float, rate: float) -> tuple[list[complex], list[complex], float]:
    """An analogue filter's roots and gain as a digital one's."""
    k = 2.0 * rate
    top = np.prod([k - z for z in zeros]) if zeros else 1.0
    bottom = np.prod([k - p for p in poles])
    dz = [(k + z) / (k - z) for z in zeros] + [-1 + 0j] * (len(poles) - len(zeros))
    return dz, [(k + p) / (k - p) for p in poles], float((gain * top / bottom).real)


@cache
def highpass(order: int, cutoff: float, rate: float) -> np.ndarray:
    """Butterworth high-pass sections."""
    warped = 2.0 * rate * np.tan(np.pi * cutoff / rate)
    poles = [warped / np.exp(1j * np.pi * (2 * k + order + 1) / (2 * order)) for k in range(order)]
    return sections(*bilinear([0j] * order, poles, 1.0, rate))


# Corner frequencies in Hz of the standard's curve, and the gain in dB that makes it about 0 dB at 1 kHz.
CORNERS = (20.598997, 107.65265, 737.86223, 12194.217)
CURVE_GAIN = 1.9997


@cache
def a_weighting(rate: float) -> np.ndarray:
    """A-weighting sections: four zeros at 0, double poles at the ends; corners are warped first, so that they come out right near half the rate."""
    f1, f2, f3, f4 = (2.0 * rate * np.tan(np.pi * f / rate) for f in CORNERS)
    return sections(*bilinear([0j] * 4, [complex(-w) for w in (f1, f1, f2, f3, f4, f4)], f4**2 * 10 ** (CURVE_GAIN / 20), rate))


def response(sos: np.ndarray, hz: np.ndarray, rate: float) -> np.ndarray:
    z = np.exp(-2j * np.pi * hz / rate)
    out = np.ones(len(hz), complex)
    for b0, b1, b2, _, a1, a2 in sos:
        out *= (b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z)
    return out


def settle(sos: np.ndarray) -> np.ndarray:
    """Section states for an input that has always been one."""
    out, level = np.zeros((len(sos), 2)), 1.0
    for k, (b0, b1, b2, _, a1, a2) in enumerate(sos):
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        out[k, 1] = (b2 - a2 * gain) * level
        out[k, 0] = (b1 - a1 * gain) * level + out[k, 1]
        level *= gain
    return out


def run_filter(sos: np.ndarray, x: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Filtered samples and the states after them.

    A section's recursion is solved in blocks: its response to a block is a
    fixed matrix, so only the two state values pass from block to block.
    """
    state = np.zeros((len(sos), 2)) if state is None else state.copy()
    y, n = np.asarray(x, np.float64), 64
    for k, (b0, b1, b2, _, a1, a2) in enumerate(sos):
        step = np.array([[-a1, 1.0], [-a2, 0.0]])
        free = np.empty((n, 2))
        pulse = np.empty(n)
        s = np.eye(2)
        drive = np.array([b1 - a1 * b0, b2 - a2 * b0])
        into = np.empty((n, 2))
        for i in range(n):
            free[i] = s[0]
            into[i] = s @ drive
            s = step @ s
        pulse[0], pulse[1:] = b0, into[:-1, 0]
        lag = np.subtract.outer(np.arange(n), np.arange(n))
        matrix = np.where(lag >= 0, pulse[np.maximum(lag, 0)], 0.0)
        pad = (-len(y)) % n
        whole = np.concatenate((y, np.zeros(pad))).reshape(-1, n)
        forced, pushed = whole @ matrix.T, whole @ into[::-1]
        out, z = np.empty_like(forced), state[k]
        full = len(y) // n
        for i in range(len(whole)):
            out[i] = forced[i] + free @ z
            if i < full:
                z = s @ z + pushed[i]
            else:  # a last part of a block
                for v in whole[i, : len(y) - full * n]:
                    o = b0 * v + z[0]
                    z = np.array([b1 * v - a1 * o + z[1], b2 * v - a2 * o])
        state[k] = z
        y = out.ravel()[: len(y)]
    return y, state


def fast_max(x: np.ndarray, rate: float = RATE, tau: float = 0.125) -> float:
    """Highest fast-weighted level of a chunk: one pole on the squares, starting at zero."""
    alpha = 1.0 - np.exp(-1.0 / (rate * tau))
    pole = np.array([[alpha, 0.0, 0.0, 1.0, alpha - 1.0, 0.0]])
    y, _ = run_filter(pole, np.asarray(x, np.float64) ** 2)
    return float(10 * np.log10(max(y.max(initial=0.0), 1e-24)))


def loudness(x: np.ndarray, state: np.ndarray | None, rate: float = RATE, offset: float = CALIBRATION) -> tuple[dict[str, float], np.ndarray]:
    """Levels of a chunk and the filter's state after it; without a state the first sample counts as what has always been."""
    x, sos = np.asarray(x, np.float64), a_weighting(rate)
    if state is None:
        state = settle(sos) * (x[0] if len(x) else 0.0)
    weighted, state = run_filter(sos, x, state)
    rms = lambda v: float(np.sqrt(np.mean(np.square(v)))) if len(v) else 0.0
    r = rms(weighted)
    return {"rms_unweighted": round(rms(x), 8), "rms_a_weighted": round(r, 8), "dBA_spl": round(20 * np.log10(r + 1e-12) + offset, 1), "LAFmax_dB": round(fast_max(weighted, rate) + offset, 1)}, state


def welch(x: np.ndarray, rate: float = RATE, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """Power density from half-overlapping Hann windows without their means."""
    n = min(segment, len(x))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    frames = np.lib.stride_tricks.sliding_window_view(np.asarray(x, np.float64), n)[:: max(1, n - n // 2)]
    spectrum = np.abs(np.fft.rfft((frames - frames.mean(axis=1, keepdims=True)) * window)) ** 2
    power = spectrum.mean(axis=0) / (rate * (window**2).sum())
    power[1 : (-1 if n % 2 == 0 else None)] *= 2
    return np.fft.rfftfreq(n, 1 / rate), power


# Where peaks are looked for, the share of a rolloff, the least power, how near two peaks lie as a part of the lower one, and points of the smoothing.
PEAKS_HZ, ROLLOFF, LEAST, NEAR, SMOOTH = (25.0, 16_000.0), 0.85, 1e-20, 2 ** (1 / 12) - 2 ** (-1 / 12), 5


def power_db(power: np.ndarray) -> np.ndarray:
    """Power in dB, rounded; none is -200."""
    return (10.0 * np.log10(np.maximum(power, LEAST))).round(1)


def peaks(hz: np.ndarray, power: np.ndarray, most: int = 3) -> list[dict[str, float]]:
    """The strongest local maxima between the bounds, smoothed; one that is near a stronger one is part of it."""
    inside = (hz >= PEAKS_HZ[0]) & (hz <= PEAKS_HZ[1])
    f, smooth = hz[inside], power[inside]
    if len(f) < 3:
        return []
    if len(f) >= SMOOTH:
        smooth = np.convolve(smooth, np.full(SMOOTH, 1 / SMOOTH), "same")
    at = np.flatnonzero((smooth[1:-1] >= smooth[:-2]) & (smooth[1:-1] > smooth[2:])) + 1
    out: list[int] = []
    for k in at[np.argsort(-smooth[at], kind="stable")].tolist():
        if all(abs(f[k] - f[o]) >= NEAR * min(f[k], f[o]) for o in out):
            out.append(k)
            if len(out) == most:
                break
    return [{"hz": float(f[k].round(1)), "db": float(power_db(smooth[k]))} for k in out]


@cache
def _bands(n: int, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, slice]:
    """Of spectra of n samples: frequencies, the A curve of power, how bands integrate power by trapezoids (both ends included), and where the bands lie."""
    hz = np.fft.rfftfreq(n, 1 / rate)
    half = 2 ** (1 / 6)
    bounds = [(c / half, c * half) for c in CENTRES] + [LOW, MID, HIGH]
    table = np.zeros((len(bounds), len(hz)))
    for k, (low, high) in enumerate(bounds):
        inside = np.flatnonzero((hz >= low) & (hz <= high))
        if len(inside) > 1:
            table[k, inside] = hz[1]
            table[k, inside[[0, -1]]] /= 2
    curve = np.abs(response(a_weighting(rate), hz, rate)) ** 2
    return hz, curve, table, slice(int(np.searchsorted(hz, LOW[0])), int(np.searchsorted(hz, HIGH[1], side="right")))


def _metrics(power: np.ndarray, n: int, rate: float, most_peaks: int) -> list[dict]:
    """Levels, peaks, centroid, rolloff and shares of energy of each row of power."""
    hz, _, table, inside = _bands(n, rate)
    bands = power @ table.T
    levels, regions = power_db(bands[:, : len(CENTRES)]), bands[:, len(CENTRES) :]
    whole = regions.sum(axis=1)
    shares = np.where(whole[:, None] > LEAST, 100.0 * regions / np.maximum(whole, LEAST)[:, None], 0.0).round(1)
    f, p = hz[inside], power[:, inside]
    total, sums = p.sum(axis=1), p.cumsum(axis=1)
    some = total > LEAST
    centroid = np.where(some, (p @ f) / np.maximum(total, LEAST), 0.0).round(1)
    at = (sums < ROLLOFF * sums[:, -1:]).sum(axis=1) if len(f) else np.zeros(len(p), int)
    rolloff = np.where(some, f[np.minimum(at, len(f) - 1)], 0.0).round(1) if len(f) else centroid
    return [
        {"levels_db": lv, "peaks": peaks(hz, row, most_peaks) if most_peaks else [], "centroid_hz": c, "rolloff_85_hz": r, "energy_pct": {"low": e[0], "mid": e[1], "high": e[2]}}
        for lv, row, c, r, e in zip(levels.tolist(), power, centroid.tolist(), rolloff.tolist(), shares.tolist())
    ]


def spectra_of(x: np.ndarray, rate: float = RATE, most_peaks: int = 3) -> list[dict]:
    """Unweighted (z) and A-weighted (a) third-octave summaries of chunks of one length, the rows of x; no samples make no power."""
    x = np.atleast_2d(np.asarray(x, np.float64))
    n = min(SEGMENT, x.shape[1])
    if not n:
        none = {"levels_db": [-200.0] * len(CENTRES), "peaks": [], "centroid_hz": 0.0, "rolloff_85_hz": 0.0, "energy_pct": {"low": 0.0, "mid": 0.0, "high": 0.0}}
        return [{"z": none, "a": none} for _ in x]
    power = np.stack([welch(row, rate)[1] for row in x]) if x.shape[1] > SEGMENT else _one_window(x, rate)
    weighted = power * _bands(n, rate)[1]
    return [{"z": z, "a": a} for z, a in zip(_metrics(power, n, rate, most_peaks), _metrics(weighted, n, rate, most_peaks))]


def _one_window(x: np.ndarray, rate: float) -> np.ndarray:
    """``welch`` of rows that are one segment each."""
    n = x.shape[1]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    power = np.abs(np.fft.rfft((x - x.mean(axis=1, keepdims=True)) * window)) ** 2 / (rate * max((window**2).sum(), LEAST))
    power[:, 1 : (-1 if n % 2 == 0 else None)] *= 2
    return power


def spectrum(x: np.ndarray, rate: float = RATE, most_peaks: int = 3) -> dict:
    """``spectra_of`` for one chunk."""
    return spectra_of(np.asarray(x, np.float64)[None, :], rate, most_peaks)[0]


def subwindow_peak_rms(x: np.ndarray, rate: float = RATE, ms: float = 200.0) -> float:
    """Highest RMS of windows side by side; a last part counts from half a window on."""
    n = int(rate * ms / 1000)
    if n <= 0 or len(x) < n:
        return float(np.sqrt(np.mean(np.square(x)))) if len(x) else 0.0
    parts = [x[k : k + n] for k in range(0, len(x), n)]
    return max(float(np.sqrt(np.mean(np.square(p)))) for p in parts if len(p) >= n / 2)


def chunk_stats(x: np.ndarray) -> dict[str, float]:
    """Largest amplitude and RMS."""
    x = np.asarray(x, np.float64)
    return {"peak": float(np.abs(x).max(initial=0.0)), "rms": float(np.sqrt(np.mean(x * x))) if len(x) else 0.0}


@cache
def mel_bank(rate: int, size: int, bands: int, low: float, high: float) -> np.ndarray:
    """Triangles between whole bins at equal steps of the mel scale, each of about the same area."""
    mel = lambda f: 2595.0 * np.log10(1 + f / 700.0)
    edges = 700.0 * (10 ** (np.linspace(mel(low), mel(high), bands + 2) / 2595.0) - 1)
    bins = np.clip(np.floor((size + 1) * edges / rate), 0, size // 2).astype(int)
    left, centre, right = bins[:-2], bins[1:-1].copy(), bins[2:].copy()
    centre += centre == left  # a triangle has a bin on either side at least
    right += right == centre
    j, (left, centre, right) = np.arange(size // 2 + 1), (v[:, None] for v in (left, centre, right))
    up, down = (j - left) / (centre - left), (right - j) / (right - centre)
    bank = np.where((j >= left) & (j < centre), up, np.where((j >= centre) & (j < right), down, 0.0))
    return bank * (2.0 / (edges[2:] - edges[:-2]))[:, None]


#: Samples whose frames stay in a core's cache.
_TOGETHER = 1 << 16


def log_mels(x: np.ndarray, rate: int = RATE, size: int = 1024, hop: int = 480, bands: int = 64, power: bool = True, low: float = 50.0, high: float = 14_000.0) -> np.ndarray:
    """Centred short-time log-mel frames of each row of x: natural log of power, or base-10 log of magnitude under a symmetric window."""
    half = size // 2
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / (size if power else size - 1))
    bank = mel_bank(rate, size, bands, low, min(high, rate / 2))
    used = np.flatnonzero(bank.any(axis=0))
    bins = slice(int(used[0]), int(used[-1]) + 1) if len(used) else slice(0, 0)  # those of the spectrum that a triangle reaches
    weights, parts = np.ascontiguousarray(bank[:, bins].T), []
    for k in range(0, len(x), few := max(1, _TOGETHER // max(x.shape[1], 1))):
        padded = np.pad(np.asarray(x[k : k + few], np.float64), ((0, 0), (half, half)), "reflect" if x.shape[1] > half else "constant")
        spectrum = np.fft.rfft(np.lib.stride_tricks.sliding_window_view(padded, size, axis=1)[:, ::hop] * window)[..., bins]
        sums = (spectrum.real**2 + spectrum.imag**2 if power else np.abs(spectrum)).reshape(-1, len(weights)) @ weights
        parts.append((np.log if power else np.log10)(np.maximum(sums, 1e-10)).reshape(*spectrum.shape[:2], bands))
    return np.concatenate(parts) if parts else np.zeros((0, 1 + x.shape[1] // hop, bands))


def log_mel(x: np.ndarray, rate: int = RATE, size: int = 1024, hop: int = 480, bands: int = 64, power: bool = True) -> np.ndarray:
    """``log_mels`` of one chunk."""
    return log_mels(np.asarray(x, np.float64)[None, :], rate, size, hop, bands, power)[0]


def fit_window(x: np.ndarray, n: int, keep_last: bool) -> np.ndarray:
    """Exactly n samples: repeated up to n, or cut to the last n; or else padded with zeros, or cut to the first n."""
    if len(x) >= n:
        return x[-n:] if keep_last else x[:n]
    return np.resize(x, n) if keep_last and len(x) else np.pad(x, (0, n - len(x)))


def classifier_wave(x: np.ndarray, gain: float = 1.0, rate: int = RATE) -> np.ndarray:
    """Samples for the sound classifier: amplified, clipped, at 16 kHz, 15,600 of them."""
    x = np.clip(np.asarray(x, np.float64) * gain, -1.0, 1.0)
    return fit_window(resample(x, 1, rate // 16_000) if len(x) else x, 15_600, False).astype(np.float32)


@dataclass(frozen=True)
class CaptionConfig:
    """How the captioning model's features are made; the names are those of its configuration file."""

    sampling_rate: int = RATE
    max_length_s: float = 10.0
    n_fft: int = 1024
    hop_length: int = 480
    feature_size: int = 64
    frequency_min: float = 50.0
    frequency_max: float = 14_000.0
    nb_max_samples: int | None = 480_000

    @property
    def samples(self) -> int:
        return int(self.nb_max_samples or self.sampling_rate * self.max_length_s)


def load_caption_config(path: str) -> CaptionConfig:
    """The defaults, overlaid by a JSON object; keys that aren't of these are left alone, and an absent file has the defaults."""
    try:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
    except FileNotFoundError:
        data = {}
    base = CaptionConfig()
    found = {k: type(getattr(base, k))(v) for k, v in data.items() if k in vars(base) and v is not None}
    return replace(base, **found)


def caption_mel(x: np.ndarray, config: CaptionConfig = CaptionConfig()) -> np.ndarray:
    """Features of the captioning model: ten seconds (the last ones, or repeated), (1001, 64) by default, natural log of power."""
    c = config
    x = fit_window(np.asarray(x, np.float64), c.samples, True)
    return log_mels(x[None, :], c.sampling_rate, c.n_fft, c.hop_length, c.feature_size, True, c.frequency_min, c.frequency_max)[0].astype(np.float32)


def detector_mel(x: np.ndarray, norm: dict[str, np.ndarray] | None = None) -> np.ndarray:
    """Features of the detector: high-passed, peak-normalised, the first ten seconds at 32 kHz, (1001, 64), base-10 log of magnitude.

    ``norm`` has mean, var, weight and bias by band, and eps, of a batch norm.
    """
    x = np.asarray(x, np.float64)
    if len(x):
        sos = highpass(4, 80.0, RATE)
        x, _ = run_filter(sos, x, settle(sos) * x[0])
        x = x / peak if (peak := np.abs(x).max()) > 1e-8 else x
        x = resample(x, 2, 3)
    mel = log_mel(fit_window(x, 320_000, False), 32_000, 1024, 320, power=False)
    if norm is not None:
        mel = (mel - norm["mean"]) / np.sqrt(norm["var"] + norm.get("eps", 1e-5)) * norm["weight"] + norm["bias"]
    return mel.astype(np.float32)


def resample(x: np.ndarray, up: int, down: int, taps: int = 20) -> np.ndarray:
    """Polyphase resampling with a Kaiser-windowed sinc."""
    most = max(up, down)
    half = taps * most // 2
    t = np.arange(-half, half + 1)
    h = np.sinc(t / most) * np.kaiser(len(t), 5.0)
    h *= up / h.sum()
    wide = np.zeros(len(x) * up)
    wide[::up] = x
    size = 1 << int(np.ceil(np.log2(len(wide) + len(h))))
    full = np.fft.irfft(np.fft.rfft(wide, size) * np.fft.rfft(h, size), size)[half : half + len(wide)]
    return full[::down]


_SIDE = "struct<levels_db:array<double>,peaks:array<struct<hz:double,db:double>>,centroid_hz:double,rolloff_85_hz:double,energy_pct:struct<low:double,mid:double,high:double>>"
SPECTRUM = f"z {_SIDE}, a {_SIDE}"
#: Samples that are transformed together.
_SAMPLES = 1 << 20
Source = Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.Array, np.ndarray]]]


def _small_batches(pcm: DataFrame, *columns: str) -> DataFrame:
    """chunk_id and pcm; samples are many, so the Arrow batches that Python workers hold get few rows."""
    pcm.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    return pcm.select(*(columns or ("chunk_id", "pcm")))


def by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """chunk_ids and samples, a row each, of the chunks of a batch that are equally long."""
    for batch in batches:
        lists = batch.column("pcm")
        size = np.diff(lists.offsets.to_numpy())
        for n in np.unique(size):
            which = np.flatnonzero(size == n)
            for k in range(0, len(which), few := max(1, _SAMPLES // max(int(n), 1))):
                some = pa.array(which[k : k + few])
                yield batch.column("chunk_id").take(some), lists.take(some).flatten().to_numpy(zero_copy_only=False).reshape(len(some), n)


def spectra(pcm: DataFrame, most_peaks: int = 3, source: Source = by_length) -> DataFrame:
    """(chunk_id, band_type, centers_hz, z, a) of chunks (chunk_id, pcm array<double>), or of what ``source`` makes samples of."""

    def run(batches):
        side = pa.struct([("levels_db", pa.list_(pa.float64())), ("peaks", pa.list_(pa.struct([("hz", pa.float64()), ("db", pa.float64())]))), ("centroid_hz", pa.float64()), ("rolloff_85_hz", pa.float64()), ("energy_pct", pa.struct([(c, pa.float64()) for c in ("low", "mid", "high")]))])
        for ids, x in source(batches):
            found = spectra_of(x, most_peaks=most_peaks)
            yield pa.RecordBatch.from_arrays([ids, *[pa.array([r[c] for r in found], side) for c in ("z", "a")]], names=["chunk_id", "z", "a"])

    rows = _small_batches(pcm) if source is by_length else pcm
    out = rows.mapInArrow(run, f"chunk_id long, {SPECTRUM}")
    return out.select("chunk_id", F.lit("third_octave").alias("band_type"), F.array(*map(F.lit, CENTRES)).alias("centers_hz"), "z", "a")


def mel_means(pcm: DataFrame, bands: int = 64, source: Source = by_length) -> DataFrame:
    """(chunk_id, frames, mel) with the mean log-mel of each chunk, or of what ``source`` makes samples of; a chunk without samples has no row."""

    def run(batches):
        for ids, x in source(batches):
            if x.shape[1]:
                mel = log_mels(x, bands=bands)
                means = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * bands, mel.mean(axis=1).round(6).ravel())
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(x), mel.shape[1], np.int32)), means], names=["chunk_id", "frames", "mel"])

    rows = _small_batches(pcm) if source is by_length else pcm
    return rows.mapInArrow(run, "chunk_id long, frames int, mel array<double>")


#: Chains from samples to a model's input, and the shape of what they give.
CHAINS = {"classifier": (classifier_wave, (15_600,)), "caption": (caption_mel, (1001, 64)), "detector": (detector_mel, (1001, 64))}


def prepared(pcm: DataFrame, chain: str) -> DataFrame:
    """(chunk_id, features) of chunks (chunk_id, pcm) by one of CHAINS, row after row of the shape; one row of input at a time is held."""
    make, shape = CHAINS[chain]

    def run(batches):
        for pdf in batches:
            for i, x in zip(pdf["chunk_id"], pdf["pcm"]):
                out = make(np.asarray(x, float))
                assert out.shape == shape
                yield pd.DataFrame({"chunk_id": [i], "features": [out.ravel()]})

    return _small_batches(pcm).mapInPandas(run, "chunk_id long, features array<float>")


def rechunked(pcm: DataFrame, samples: int = 46_800) -> DataFrame:
    """(device_id, window, pcm): each device's samples in windows of a fixed number, side by side; a last part is left out."""

    def run(batches):
        device, held, window = None, np.zeros(0), 0
        for pdf in batches:
            out = []
            for d, x in zip(pdf["device_id"], pdf["pcm"]):
                if d != device:
                    device, held, window = d, np.zeros(0), 0
                held = np.concatenate((held, np.asarray(x, float)))
                while len(held) >= samples:
                    out.append((d, window, held[:samples]))
                    held, window = held[samples:], window + 1
            yield pd.DataFrame(out, columns=["device_id", "window", "pcm"])

    rows = pcm.select("device_id", "chunk_id", "pcm").repartition("device_id").sortWithinPartitions("device_id", "chunk_id")
    return rows.mapInPandas(run, "device_id string, window int, pcm array<double>")


@cache
def _step(path: bytes, n: int) -> np.ndarray:
    """How n samples of silence change the states of sections."""
    sos = np.frombuffer(path).reshape(-1, 6)
    size = 2 * len(sos)
    one = np.stack([run_filter(sos, np.zeros(1), unit.reshape(-1, 2))[1].ravel() for unit in np.eye(size)], axis=1)
    return np.linalg.matrix_power(one, n)


class FilterMaps:
    """What chunks do to a filter's states, as maps that compose: number of samples, the first one, and the states that they leave from zero."""

    def __init__(self, sos: np.ndarray) -> None:
        self.sos, self.raw, self.rest = sos, np.ascontiguousarray(sos).tobytes(), settle(sos).ravel()

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate(([len(x), x[0] if len(x) else np.nan], run_filter(self.sos, x)[1].ravel()))

    def combine(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        first = b[1] if np.isnan(a[1]) else a[1]
        return np.concatenate(([a[0] + b[0], first], _step(self.raw, int(b[0])) @ a[2:] + b[2:]))

    def act(self, state: np.ndarray | None, m: np.ndarray) -> np.ndarray | None:
        if state is None:
            if np.isnan(m[1]):
                return None
            state = self.rest * m[1]
        return _step(self.raw, int(m[0])) @ state + m[2:]


def with_filter_states(pcm: DataFrame, sos: np.ndarray, keys: list[str], place: str) -> DataFrame:
    """``pcm`` with ``state``, what the filter remembers before each chunk of its key (null before the first sample).

    Chunks are filtered from zero, wherever they lie, to one small map each; maps
    are composed along ``place``, and each chunk gets its state back by a join.
    So one recording takes as many tasks as its samples have partitions.
    """
    maps = FilterMaps(sos)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.drop(columns="pcm").assign(map=pd.Series([maps.of(np.asarray(x, float)) for x in pdf["pcm"]], dtype=object, index=pdf.index))

    names = [f"_k{i}" for i in range(len(keys))]  # a null key is one of its own
    named = pcm.select("*", *[F.coalesce(F.concat(F.lit("k"), F.col(k).cast("string")), F.lit("")).alias(n) for k, n in zip(keys, names)])
    rows = _small_batches(named, *names, F.col(place).cast("long").alias("place"), "pcm").mapInPandas(run, ", ".join(f"{n} string" for n in names) + ", place long, map array<double>")
    states = scan.before(rows, names, maps.combine, maps.act, levels=2).withColumnRenamed("place", "_place")
    return named.withColumn("_place", F.col(place).cast("long")).join(states, [*names, "_place"]).drop(*names, "_place")


def loudness_of(pcm: DataFrame) -> DataFrame:
    """Levels of chunks (device_id, recording_id, chunk_index, pcm); the filter's memory passes from chunk to chunk of a recording, whose chunk_index are distinct."""
    names = ["rms_unweighted", "rms_a_weighted", "dBA_spl", "LAFmax_dB"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [loudness(np.asarray(x, float), None if s is None else np.asarray(s).reshape(-1, 2))[0] for x, s in zip(pdf["pcm"], pdf["state"])]
            yield pdf.drop(columns=["pcm", "state"]).assign(**{c: [r[c] for r in found] for c in names})

    rows = with_filter_states(pcm.select("device_id", "recording_id", "chunk_index", "pcm"), a_weighting(RATE), ["device_id", "recording_id"], "chunk_index")
    return rows.mapInPandas(run, "device_id string, recording_id string, chunk_index int, " + ", ".join(f"{c} double" for c in names))


TONE_SAMPLES = 4800


@cache
def _sines() -> np.ndarray:
    """A sine of full strength for each pitch that a tone may have."""
    hz = 100.0 * (1 + np.arange(50))
    return np.sin(2 * np.pi * hz[:, None] * np.arange(TONE_SAMPLES) / RATE)


def tone_of(ids: np.ndarray, dba: np.ndarray) -> np.ndarray:
    """A sine for each id, a row each: its pitch follows from the id, its strength from the level."""
    return 10.0 ** ((dba - CALIBRATION) / 20)[:, None] * _sines()[ids % 50]


def tone_source(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Samples made of (chunk_id, dba) where they are needed, so they never leave the worker."""
    for batch in batches:
        ids, dba = batch.column("chunk_id"), batch.column("dba").to_numpy(zero_copy_only=False)
        for k in range(0, len(ids), few := _SAMPLES // TONE_SAMPLES):
            yield ids.slice(k, few), tone_of(ids.slice(k, few).to_numpy(), dba[k : k + few])


def tone_rows(chunks: DataFrame) -> DataFrame:
    """What ``tone_source`` reads, dealt to all cores: a few bytes of table become many samples."""
    return chunks.select("chunk_id", "dba").repartition(4 * chunks.sparkSession.sparkContext.defaultParallelism, "chunk_id")


def tones(chunks: DataFrame) -> DataFrame:
    """(chunk_id, pcm): the samples of ``tone_source``, for tests."""

    def run(batches):
        for ids, x in tone_source(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array(list(x))], names=["chunk_id", "pcm"])

    return tone_rows(chunks).mapInArrow(run, "chunk_id long, pcm array<double>")
