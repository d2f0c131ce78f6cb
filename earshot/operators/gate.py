"""Ambient floor, warmth, hysteresis gate and smoothed gain.

A row has three levels: ``raw`` (RMS of the whole chunk, dBFS), ``level`` (the
loudest sub-window's RMS, dBFS) and ``peak`` (largest amplitude).  The floor is
that of ``raw``; the gate and its jumps look at ``level``; the gain brings the
mean amplitude of the last open rows to the target, within the peak's and the
floor's limits.  One stage works on rows in order from a small state to another;
batch, streaming and samples share it.  In batch a recording is cut into
stretches that are maps of the gate's states, so no task needs all its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.acoustics import from_dbfs
from . import dsp, scan
from .segment import numbered

# The gate's settings.
TARGET, MARGIN, SLACK = -23.0, 18.0, 12.0
GAIN_MIN, GAIN_MAX, CEILING = 12.0, 40.0, 0.9
WINDOW, SENSITIVITY, PERCENT = 300, 5.0, 0.1
DELTA, DELTA_MIN, RELEASE, SMOOTH = 4.0, -55.0, 2, 5
HIGHPASS_HZ, HIGHPASS_ORDER, SUBWINDOW_MS = 80.0, 4, 200.0
#: dB between full scale and sound pressure.
CALIBRATION = 120.0
#: Amplitudes below this count as silence.
EPSILON = 1e-12
#: Rows of a stretch, a few times those of a window.
STRETCH = 4096
#: Rows whose windows are sorted at once.
_ROWS = 4096


def levels(chunks: DataFrame) -> DataFrame:
    """Chunks with raw, level and peak from their sound levels; where samples are at hand, ``from_samples`` measures them."""
    level = F.coalesce("lafmax", "dba") - F.lit(CALIBRATION)
    return chunks.withColumn("raw", F.col("dba") - F.lit(CALIBRATION)).withColumn("level", level).withColumn("peak", from_dbfs(level + F.lit(3.0)))


@dataclass
class GateState:
    """What a device carries from row to row: raw levels of the window, the level before, the gate, amplitudes of the last open rows."""

    history: list[float] = field(default_factory=list)
    previous: float | None = None
    open: bool = False
    streak: int = 0
    amplitudes: list[float] = field(default_factory=list)


def floors(history: list[float], raw: np.ndarray) -> np.ndarray:
    """For each row the percentile of the rows of the window before it, linear between two, to nine decimals; the first row has its own level."""
    whole = np.concatenate((np.asarray(history, float), raw))
    begin, out = len(history), np.empty(len(raw))
    for k in range(begin, len(whole)):  # windows that aren't full yet
        if k >= WINDOW:
            break
        some = np.sort(whole[:k]) if k else whole[:1]
        at = (len(some) - 1) * PERCENT
        low = some[int(at)]
        out[k - begin] = low + (some[min(int(at) + 1, len(some) - 1)] - low) * (at - int(at))
    full = max(0, WINDOW - begin)
    at = (WINDOW - 1) * PERCENT
    for k in range(full, len(raw), _ROWS):
        stop = min(k + _ROWS, len(raw))
        view = np.lib.stride_tricks.sliding_window_view(whole[begin + k - WINDOW : begin + stop - 1], WINDOW)
        two = np.partition(view, (int(at), int(at) + 1), axis=1)[:, int(at) : int(at) + 2]
        out[k:stop] = two[:, 0] + (two[:, 1] - two[:, 0]) * (at - int(at))
    return np.round(out, 9)


#: States of the gate: 0 is closed, 1 + k is open after k rows below.
STATES = RELEASE + 1


def transitions(level: np.ndarray, floor: np.ndarray, delta: np.ndarray, warm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row the state that each state goes to, and whether the row is above the floor and whether it jumps."""
    above = (level >= floor + SENSITIVITY) & warm
    jump = warm & (level >= DELTA_MIN) & (np.nan_to_num(delta, nan=-np.inf) >= DELTA)
    out = np.empty((len(level), STATES), np.int8)
    out[:, 0] = above | jump
    for k in range(RELEASE):  # one row more below; where that closes the gate, a jump opens it again
        out[:, 1 + k] = np.where(above, 1, k + 2 if k + 1 < RELEASE else jump)
    return out, above, jump


def composed(steps: np.ndarray) -> np.ndarray:
    """For each row the state that each state has become after it: maps of the rows composed by doubling."""
    out, wide = steps.copy(), 1
    while wide < len(out):
        out[wide:] = np.take_along_axis(out[wide:], out[:-wide].astype(np.intp), axis=1)
        wide *= 2
    return out


def gate_rows(state: GateState, level: np.ndarray, floor: np.ndarray, delta: np.ndarray, warm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether the gate is open at each row, why, and its streak; from the state and to it."""
    steps, above, jump = transitions(level, floor, delta, warm)
    start = 1 + state.streak if state.open else 0
    after = composed(steps)[:, start].astype(np.int64)
    prior = np.concatenate(([start], after))[: len(after)]
    held = np.where(prior > 0, above | (prior < RELEASE), above)  # open without a jump
    reason = np.where(held, np.where(prior > 0, "hold", "l90"), np.where(jump, "delta", "closed"))
    if len(after):
        state.open, state.streak = bool(after[-1]), max(int(after[-1]) - 1, 0)
    return after > 0, reason, np.maximum(after - 1, 0)


def _ambient(state: GateState, raw: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Floor, step from the level before, largest gain and warmth of each row: what rows before it tell whatever the gate did."""
    floor = floors(state.history, raw)
    delta = level - np.concatenate(([np.nan if state.previous is None else state.previous], level))[: len(level)]
    most = np.clip(TARGET - floor - MARGIN, GAIN_MIN, GAIN_MAX)
    return floor, delta, most, level + most >= TARGET - SLACK


def stage_rows(state: GateState, raw: np.ndarray, level: np.ndarray, peak: np.ndarray) -> dict[str, np.ndarray]:
    """The whole stage over rows in order, from the state and to it."""
    floor, delta, most, warm = _ambient(state, raw, level)
    is_open, reasons, streaks = gate_rows(state, level, floor, delta, warm)
    count = np.minimum(len(state.history) + 1 + np.arange(len(raw)), WINDOW)
    amplitude = 10.0 ** (raw / 20.0)
    smooth, gain = np.where(is_open, 0.0, amplitude), np.zeros(len(raw))
    at = np.flatnonzero(is_open)
    if len(at):
        kept = np.concatenate((np.zeros(SMOOTH - 1 - len(state.amplitudes)), state.amplitudes, amplitude[at]))
        known = np.minimum(len(state.amplitudes) + 1 + np.arange(len(at)), SMOOTH)
        smooth[at] = np.lib.stride_tricks.sliding_window_view(kept, SMOOTH).sum(axis=1) / known
        limit = np.where(peak[at] > EPSILON, CEILING / np.maximum(peak[at], EPSILON), np.inf)
        gain[at] = np.minimum(np.minimum(10.0 ** (TARGET / 20.0) / np.maximum(smooth[at], EPSILON), limit), 10.0 ** (most[at] / 20.0))
        state.amplitudes = [*state.amplitudes, *amplitude[at].tolist()][-(SMOOTH - 1) :]
    if len(raw):
        state.history = [*state.history, *raw.tolist()][-WINDOW:]
        state.previous = float(level[-1])
    return {
        "floor": floor, "delta": delta, "max_gain": most, "warm": warm, "gate_open": is_open, "reason": reasons, "streak": streaks,
        "ambient_count": count, "smoothed": 20.0 * np.log10(np.maximum(smooth, EPSILON)), "gain": gain,
    }


# A stretch of rows as a map: for each state of the gate the state after it, the number of open rows and the amplitudes of the last of them.
_CELL = 1 + SMOOTH


def _cells(m: np.ndarray) -> list[tuple[int, list[float]]]:
    return [(int(c[0]), c[2 : 2 + int(c[1])].tolist()) for c in np.asarray(m).reshape(-1, _CELL)]


def _flat(cells: list[tuple[int, list[float]]]) -> np.ndarray:
    return np.array([[end, len(last), *last, *[0.0] * (SMOOTH - 1 - len(last))] for end, last in cells]).ravel()


def stretch_map(state: GateState, raw: np.ndarray, level: np.ndarray) -> np.ndarray:
    """What a stretch does to the gate and the amplitudes; ``state`` has the window and the level before it only."""
    floor, delta, _, warm = _ambient(state, raw, level)
    after, amplitude = composed(transitions(level, floor, delta, warm)[0]), 10.0 ** (raw / 20.0)
    return _flat([(after[-1, k], amplitude[np.flatnonzero(after[:, k])[-(SMOOTH - 1) :]].tolist()) for k in range(STATES)])


def join_maps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two stretches in turn as one."""
    later = _cells(b)
    return _flat([(later[end][0], [*last, *later[end][1]][-(SMOOTH - 1) :]) for end, last in _cells(a)])


def after_map(state: np.ndarray | None, m: np.ndarray) -> np.ndarray:
    """The state (one cell) after a stretch; before all rows the gate is closed."""
    start, last = _cells(state)[0] if state is not None else (0, [])
    end, more = _cells(m)[start]
    return _flat([(end, [*last, *more][-(SMOOTH - 1) :])])


STAGE = "floor double, delta double, max_gain double, warm boolean, gate_open boolean, reason string, streak int, ambient_count int, smoothed double, gain double"


def _frame(pdf: pd.DataFrame, keys: list[str], state: GateState) -> pd.DataFrame:
    out = stage_rows(state, *(pdf[c].to_numpy(float) for c in ("raw", "level", "peak")))
    return pd.DataFrame({**{k: pdf[k] for k in keys}, **out})


def keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with _device and _recording, strings without nulls; rows without a recording are one of their device."""
    recording = F.col("recording_id") if "recording_id" in rows.columns else F.lit(None).cast("string")
    known = lambda c: F.coalesce(F.concat(F.lit("k"), c), F.lit(""))
    return rows.withColumn("_device", known(F.col("device_id"))).withColumn("_recording", known(recording))


def stage(rows: DataFrame, stretch: int = STRETCH, carry: tuple[str, ...] = ()) -> DataFrame:
    """(device_id, chunk_id, raw, level, peak), the columns of STAGE and those to ``carry``, from rows with dt_utc and perhaps recording_id too.

    The rows of a recording are numbered in order and cut into stretches, each
    with the window before it.  Every stretch is a map of the gate's states; the
    maps are composed, and each stretch then runs from the state before it.  So
    a device with all rows takes as many tasks as it has stretches.
    """
    own = ["device_id", *(["recording_id"] if "recording_id" in rows.columns else [])]
    keys, values = ["_device", "_recording"], [*own, "chunk_id", "raw", "level", "peak", *carry]
    rn = numbered(keyed(rows.select("dt_utc", *[c for c in values if c != "dt_utc"])), keys).select(*keys, *values, "rn")
    place = F.floor((F.col("rn") - 1) / stretch)
    # The last rows of a stretch come to those after it too, as far as their windows reach.
    ahead = F.floor((F.col("rn") - 1 + WINDOW) / stretch)
    spread = rn.withColumn("own", place).withColumn("place", F.explode(F.sequence(place, ahead)))

    def parts(pdf: pd.DataFrame) -> tuple[pd.DataFrame, GateState]:
        pdf = pdf.sort_values("rn")
        halo, rest = pdf[pdf["own"] != pdf["place"]].tail(WINDOW), pdf[pdf["own"] == pdf["place"]]
        return rest, GateState(halo["raw"].tolist(), float(halo["level"].iloc[-1]) if len(halo) else None)

    def maps(pdf: pd.DataFrame) -> pd.DataFrame:
        rest, state = parts(pdf)
        if not len(rest):
            return pdf[[*keys, "place"]].head(0).assign(map=pd.Series([], dtype=object))
        return rest[[*keys, "place"]].head(1).assign(map=[stretch_map(state, rest["raw"].to_numpy(float), rest["level"].to_numpy(float))])

    def final(pdf: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        rest, state = parts(pdf)
        if len(start) and (held := start["state"].iloc[0]) is not None:
            at, state.amplitudes = _cells(held)[0]
            state.open, state.streak = at > 0, max(at - 1, 0)
        return _frame(rest, values, state)

    groups = spread.groupBy(*keys, "place")
    found = groups.applyInPandas(maps, "_device string, _recording string, place long, map array<double>")
    starts = scan.before(found, keys, join_maps, after_map)
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in values)
    return groups.cogroup(starts.groupBy(*keys, "place")).applyInPandas(final, f"{kinds}, {STAGE}")


def diagnostics() -> Column:
    """A staged row's diagnostics as events hold them: rounded values, and the settings."""
    one = lambda c: F.round(F.col(c), 1)
    fixed = {
        "gate_mode": "dynamic_l90", "hpf_hz": HIGHPASS_HZ, "hpf_order": HIGHPASS_ORDER, "target_dbfs": TARGET, "ambient_gain_margin_db": MARGIN, "effective_slack_db": SLACK,
        "max_gain_min_db": GAIN_MIN, "max_gain_ceiling_db": GAIN_MAX, "min_effective_dbfs": TARGET - SLACK, "ambient_window_chunks": WINDOW, "ambient_percentile": 100 * PERCENT,
        "gate_sensitivity_db": SENSITIVITY, "gate_delta_db": DELTA, "gate_delta_min_dbfs": DELTA_MIN, "gate_subwindow_ms": SUBWINDOW_MS, "gate_release_chunks": RELEASE, "gain_smooth_chunks": SMOOTH,
    }
    values = {
        "max_gain_db": one("max_gain"), "effective_level_dbfs": F.round(F.col("level") + F.col("max_gain"), 1), "ambient_noise_floor_dbfs": one("floor"), "ambient_sample_count": F.col("ambient_count"),
        "silence_gate_open_dbfs": F.round(F.col("floor") + F.lit(SENSITIVITY), 1), "gate_level_dbfs": one("level"), "delta_rms_dbfs": F.round(F.nanvl(F.col("delta"), F.lit(None)), 1), "below_open_streak": F.col("streak"),
        "gate_open_reason": F.col("reason"), "gate_open": F.col("gate_open"), "gated": ~F.col("gate_open"), "applied_gain": F.round("gain", 4), "raw_rms_dbfs": one("raw"), "smoothed_rms_dbfs": one("smoothed"),
    }
    return F.struct(*[F.lit(v).alias(k) for k, v in fixed.items()], *[v.alias(k) for k, v in values.items()])


def metadata(staged: DataFrame) -> DataFrame:
    """The diagnostics of each staged row."""
    return staged.select("device_id", "chunk_id", diagnostics().alias("yamnet_preprocess"))


def highpass(rate: float = dsp.RATE) -> np.ndarray:
    """The stage's high-pass filter."""
    return dsp.highpass(HIGHPASS_ORDER, HIGHPASS_HZ, rate)


def measure(x: np.ndarray, state: np.ndarray | None, rate: float = dsp.RATE) -> tuple[tuple[float, float, float], np.ndarray, np.ndarray]:
    """raw, level and peak of a chunk, its high-passed samples, and the filter's state after it; without a state the first sample counts as what has always been."""
    sos = highpass(rate)
    if state is None:
        state = dsp.settle(sos) * (x[0] if len(x) else 0.0)
    y, state = dsp.run_filter(sos, x, state)
    rms = float(np.sqrt(np.mean(np.square(y)))) if len(y) else 0.0
    raw, level = (20.0 * np.log10(max(v, EPSILON)) for v in (rms, dsp.subwindow_peak_rms(y, rate, SUBWINDOW_MS)))
    return (raw, level, float(np.abs(y).max(initial=0.0))), y, state


def from_samples(pcm: DataFrame, rate: float = dsp.RATE) -> DataFrame:
    """(device_id, recording_id if given, dt_utc, chunk_id, raw, level, peak) of chunks (the same and pcm); the high-pass remembers the chunks before, in any number of tasks."""
    own = ["device_id", *(["recording_id"] if "recording_id" in pcm.columns else []), "dt_utc", "chunk_id"]
    sos = highpass(rate)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [measure(np.asarray(x, float), None if held is None else np.reshape(held, (-1, 2)), rate)[0] for x, held in zip(pdf["pcm"], pdf["state"])]
            yield pd.concat((pdf[own], pd.DataFrame(found, columns=["raw", "level", "peak"], index=pdf.index, dtype=float)), axis=1)

    rows = numbered(keyed(pcm.select(*own, "pcm")), ["_device", "_recording"])
    rows = dsp.with_filter_states(rows, sos, ["_device", "_recording"], "rn")
    kinds = {"device_id": "string", "recording_id": "string", "dt_utc": "timestamp", "chunk_id": "long"}
    return rows.select(*own, "pcm", "state").mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in own) + ", raw double, level double, peak double")


def from_state(values: tuple | None) -> GateState:
    """A state from the row that a stream keeps."""
    return GateState(*values) if values else GateState()


__all__ = ["GateState", "after_map", "astuple", "composed", "diagnostics", "floors", "from_samples", "from_state", "gate_rows", "join_maps", "highpass", "keyed", "levels", "measure", "metadata", "stage", "stage_rows", "stretch_map", "transitions"]
