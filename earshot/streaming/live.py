"""The gate and the capture rule over live telemetry.

State is kept by device and recording and ends with the recording; rows go
through the folds of the batch operators in the order of their times
(``ordered.py``), so both give the same rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import gate as g
from ..operators.capture import SCHEMA as CAPTURE_SCHEMA
from ..operators.capture import CaptureState, run_rows
from ..sources.labels import TriggerConfig
from .ordered import in_order

_ROW = "chunk_id long, raw double, level double, peak double"
GATE_SCHEMA = f"device_id string, recording_id string, {_ROW}, {g.STAGE}"
_GATE_STATE = "history array<double>, previous double, open boolean, streak int, amplitudes array<double>"
_CAPTURE_STATE = "last_arm double, active boolean, seconds double, peak double, closed int, decay int, armed_id long, run int, levels array<double>"


def held(kind: type, state: tuple | None):
    """The state that a recording left, lists as lists."""
    return kind(*[list(v) if hasattr(v, "__len__") and not isinstance(v, str) else v for v in state]) if state is not None else kind()


def plain(state) -> tuple:
    """A state as a row of plain values."""
    return tuple([float(x) for x in v] if isinstance(v, list) else v.item() if hasattr(v, "item") else v for v in vars(state).values())


def _gate_fold(before: tuple | None, pdf: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
    state = held(g.GateState, before)
    out = g._frame(pdf, ["chunk_id", "raw", "level", "peak"], state)
    return plain(state), out


def live_gate(chunks: DataFrame, late: str = "10 minutes", silent: str = "30 minutes") -> DataFrame:
    """Streaming (device_id, recording_id if any, dt_utc, chunk_id, raw, level, peak) to the gate stage's columns at each row."""
    return in_order(chunks, f"us long, {_ROW}", _GATE_STATE, _gate_fold, f"{_ROW}, {g.STAGE}", late, silent)


def heartbeat(chunks: DataFrame, late: str = "10 minutes", silent: str = "5 minutes") -> DataFrame:
    """Streaming session of each device: a device that is silent for that long ends its session, with its rows and last level."""
    session = F.session_window("dt_utc", silent).alias("session")
    return chunks.withWatermark("dt_utc", late).groupBy("device_id", session).agg(F.count("*").alias("chunks"), F.max_by("dba", "dt_utc").alias("last_dba"), F.max("dt_utc").alias("last_utc"))


def live_captures(chunks: DataFrame, config: TriggerConfig = TriggerConfig(), late: str = "10 minutes", silent: str = "30 minutes") -> DataFrame:
    """Streaming chunks to the status of each row and the captures that end."""
    config = config.normalised()

    def fold(before: tuple | None, pdf: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        state = held(CaptureState, before)
        out = run_rows(state, pdf.assign(seconds=pdf["us"] / 1e6, device_id=""), config)
        return plain(state), out.drop(columns="device_id")

    columns = "us long, chunk_id long, top_label string, dba double, gated boolean"
    return in_order(chunks, columns, _CAPTURE_STATE, fold, CAPTURE_SCHEMA.removeprefix("device_id string, "), late, silent)


def live_levels(chunks: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Levels by device and window of event time, once the watermark has passed it."""
    from ..functions.acoustics import leq

    return chunks.withWatermark("dt_utc", late).groupBy("device_id", F.window("dt_utc", window)).agg(leq(F.col("dba")).alias("leq_db"), F.count("*").alias("chunks"), F.max("lafmax").alias("max_lafmax"))


def without_warm_up(chunks: DataFrame, first: int = 3) -> DataFrame:
    """Rows after the first chunks of a recording, which the microphone needs to settle."""
    return chunks.filter(F.col("chunk_index") >= first)


def write_events(events: DataFrame, path: str, checkpoint: str):
    """A streaming query that appends JSON Lines by day, exactly once for each micro-batch."""
    return events.writeStream.format("json").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
