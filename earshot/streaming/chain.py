"""From samples to stored events: one chain, as a batch and as a stream.

Align, loudness with its filter's memory, spectrum, gate stage with its own, the
scorer where the gate is open, and events as they are stored.  In batch the
memories are composed over all tasks; in a stream they are a recording's state.
The source hands a recording's chunks out in order, so the stream needs no
watermark to know that a chunk's turn has come; a recording that is silent for
long ends, in processing time, and leaves nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators import dsp, gate
from ..sources.events import build_events
from .live import _GATE_STATE, held, plain
from .ordered import KEYS

Scorer = Callable[[np.ndarray], list[tuple[str, float]]]
_PREDICTIONS = "predictions array<struct<label:string,confidence:double>>"
_LEVELS = "rms_unweighted double, rms_a_weighted double, dba double, lafmax double"
_MEASURED = f"device_id string, recording_id string, chunk_id long, chunk_index int, dt_utc timestamp, {_LEVELS}, raw double, level double, peak double, {gate.STAGE}, {dsp.SPECTRUM}, {_PREDICTIONS}"
_STATE = f"turn int, weighting array<double>, highpass array<double>, {_GATE_STATE}"
#: The label of a chunk whose gate is closed.
GATED = "gated"


def _scored(model: Scorer, y: np.ndarray, is_open: bool, gain: float, top: int) -> list[dict] | None:
    """Predictions of a chunk's high-passed samples, made up where the gate is closed, null where the model fails."""
    if not is_open:
        return [{"label": GATED, "confidence": float(k == 0)} for k in range(max(top, 1))]
    try:
        found = sorted(model(dsp.classifier_wave(y, gain)), key=lambda p: -p[1])[:top]
    except (ValueError, RuntimeError):
        return None
    return [{"label": a, "confidence": float(b)} for a, b in found]


def _in_turn(rows: Iterator[pd.DataFrame], turn: int) -> Iterator[tuple]:
    """Rows by chunk_index; those that come before their turn wait."""
    waiting: dict[int, tuple] = {}
    for pdf in rows:
        for row in pdf[["chunk_index", "chunk_id", "dt_utc", "samples"]].itertuples(index=False):
            waiting[row[0]] = row
            while turn in waiting:
                yield waiting.pop(turn)
                turn += 1
    for k in sorted(waiting):  # after a gap
        yield waiting[k]


def _measure(x: np.ndarray, weighting: np.ndarray | None, high: np.ndarray | None) -> tuple[tuple, np.ndarray, np.ndarray, np.ndarray]:
    """What a chunk's samples tell by themselves, its high-passed samples, and the states of both filters after it."""
    levels, weighting = dsp.loudness(x, weighting)
    measured, y, high = gate.measure(x, high)
    spectrum = dsp.spectrum(x)
    return (*levels.values(), *measured, spectrum["z"], spectrum["a"]), y, weighting, high


_NAMES = ["rms_unweighted", "rms_a_weighted", "dba", "lafmax", "raw", "level", "peak", "z", "a"]


class SampleStage(StatefulProcessor):
    """A recording's chunks, in order, from samples to all that is measured of them."""

    #: Chunks that are measured together.
    BLOCK = 32

    def __init__(self, load: Callable[[], Scorer], top: int, silent_ms: int) -> None:
        self.load, self.top, self.silent_ms = load, top, silent_ms

    def init(self, handle: Any) -> None:
        self.handle, self.model = handle, self.load()
        self.held = handle.getValueState("held", _STATE)
        self.ends = handle.getValueState("ends", "ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        before = tuple(self.held.get()) if self.held.exists() else None
        turn, weighting, high = (0, None, None) if before is None else (before[0], *(np.reshape(v, (-1, 2)) for v in before[1:3]))
        state, block = held(gate.GateState, before[3:] if before else None), []

        def measured() -> pd.DataFrame:
            out = pd.DataFrame([b[:-1] for b in block], columns=["chunk_index", "chunk_id", "dt_utc", *_NAMES])
            staged = gate.stage_rows(state, *(out[c].to_numpy(float) for c in ("raw", "level", "peak")))
            out = out.assign(**staged, **dict(zip(KEYS, key)))
            out["predictions"] = [_scored(self.model, b[-1], o, g, self.top) for b, o, g in zip(block, staged["gate_open"], staged["gain"])]
            return out[out["predictions"].notna()]

        for index, chunk, at, samples in _in_turn(rows, turn):
            x = dsp.aligned(np.asarray(samples))
            values, y, weighting, high = _measure(x, weighting, high)
            block.append((index, chunk, at, *values, y))
            turn = index + 1
            if len(block) == self.BLOCK:
                yield measured()
                block.clear()
        if block:
            yield measured()
        if weighting is not None:
            self.held.update((turn, weighting.ravel().tolist(), high.ravel().tolist(), *plain(state)))
            ends = timerValues.getCurrentProcessingTimeInMs() + self.silent_ms
            if self.ends.exists():
                self.handle.deleteTimer(self.ends.get()[0])
            self.ends.update((ends,))
            self.handle.registerTimer(ends)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.held.clear()
        self.ends.clear()
        return iter(())

    def close(self) -> None:
        pass


def _events(measured: DataFrame, model: str, version: str) -> DataFrame:
    """Measured rows as stored events, with the diagnostics of the gate and the A and Z spectrum."""
    spectrum = F.struct(F.lit("third_octave").alias("band_type"), F.array(*map(F.lit, dsp.CENTRES)).alias("centers_hz"), "z", "a")
    return build_events(measured.withColumn("spectrum", spectrum).withColumn("yamnet_preprocess", gate.diagnostics()), model, version)


def live_events(samples: DataFrame, load: Callable[[], Scorer], top: int = 3, model: str = "scorer", version: str = "1", silent_s: float = 1800.0) -> DataFrame:
    """Streaming samples (the columns of ``sources.samples``) to events; each Python worker loads the scorer once."""
    samples.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    samples.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")  # a row has tens of thousands of samples
    keyed = samples.select(*KEYS, "chunk_id", "chunk_index", "dt_utc", "samples").groupBy(*KEYS)
    return _events(keyed.transformWithStateInPandas(SampleStage(load, top, int(1000 * silent_s)), _MEASURED, "Append", "ProcessingTime"), model, version)


def batch_events(samples: DataFrame, load: Callable[[], Scorer], top: int = 3, model: str = "scorer", version: str = "1") -> DataFrame:
    """The same events from all samples at once, a recording in as many tasks as it has partitions."""
    at, kinds = [*KEYS, "chunk_id"], "device_id string, recording_id string, chunk_id long"
    pcm = samples.withColumn("pcm", dsp.align(F.col("samples"))).select(*at, "chunk_index", "dt_utc", "pcm")
    known = dsp.with_filter_states(pcm, dsp.a_weighting(dsp.RATE), KEYS, "chunk_index").withColumnRenamed("state", "weighting")
    known = dsp.with_filter_states(known, gate.highpass(), KEYS, "chunk_index").withColumnRenamed("state", "high")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            states = [[None if v is None else np.reshape(v, (-1, 2)) for v in pdf[c]] for c in ("weighting", "high")]
            found = [_measure(np.asarray(x), w, h)[0] for x, w, h in zip(pdf["pcm"], *states)]
            yield pd.concat((pdf[[*at, "chunk_index", "dt_utc", "high"]], pd.DataFrame(found, columns=_NAMES, index=pdf.index)), axis=1)

    measured = known.mapInPandas(measure, f"{kinds}, chunk_index int, dt_utc timestamp, high array<double>, {_LEVELS}, raw double, level double, peak double, {dsp.SPECTRUM}")
    staged = gate.stage(measured, carry=("chunk_index", "dt_utc", "high", "rms_unweighted", "rms_a_weighted", "dba", "lafmax", "z", "a"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = load()
        for pdf in batches:
            waves = (gate.measure(np.asarray(x), None if h is None else np.reshape(h, (-1, 2)))[1] if o else None for x, h, o in zip(pdf["pcm"], pdf["high"], pdf["gate_open"]))
            pdf["predictions"] = [_scored(scorer, y, o, g, top) for y, o, g in zip(waves, pdf["gate_open"], pdf["gain"])]
            yield pdf[pdf["predictions"].notna()].drop(columns=["pcm", "high"])

    return _events(staged.join(pcm.select(*at, "pcm"), at).mapInPandas(score, _MEASURED), model, version)
