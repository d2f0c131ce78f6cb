"""Folds over the rows of a recording in event-time order, whatever order batches bring them in.

A recording is the key.  Its rows wait in a list until the watermark has passed
them, so that none can come before them any more, and then go through the fold
in order.  A timer in event time lets go the last ones; another ends the
recording once it has been silent for long, and nothing of it is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: From a recording's state (None at its beginning) and rows in order to the state after them and what they give.
Fold = Callable[[tuple | None, pd.DataFrame], tuple[tuple, pd.DataFrame]]
KEYS = ["device_id", "recording_id"]


class InOrder(StatefulProcessor):
    """``fold`` over the rows of each key, held back until their turn; ``columns`` (DDL) are a row's, the first two its time in microseconds and its number."""

    def __init__(self, columns: str, state: str, fold: Fold, silent_ms: int) -> None:
        self.columns, self.state, self.fold, self.silent_ms = columns, state, fold, silent_ms
        self.names = [c.split()[0] for c in columns.split(", ")]

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.columns)
        self.held = handle.getValueState("held", self.state)
        self.last = handle.getValueState("last", "us long")

    def _release(self, key: tuple, rows: list[tuple], upto_ms: int | None) -> Iterator[pd.DataFrame]:
        """Rows up to a time through the fold (None: all); the others wait for a timer at their latest."""
        ready = [r for r in rows if upto_ms is None or r[0] < 1000 * upto_ms]
        if ready:
            pdf = pd.DataFrame(ready, columns=self.names).sort_values(self.names[:2], kind="stable", ignore_index=True)
            state, out = self.fold(tuple(self.held.get()) if self.held.exists() else None, pdf)
            self.held.update(state)
            yield out.assign(**dict(zip(KEYS, key)))
        rest = [r for r in rows if upto_ms is not None and r[0] >= 1000 * upto_ms]
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(max(r[0] for r in rest) // 1000 + 1)
        elif len(rows):
            self.waiting.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        new = [tuple(x) for pdf in rows for x in pdf[self.names].astype(object).where(pdf[self.names].notna(), None).itertuples(index=False)]
        if not new:
            return
        last = max(r[0] for r in new)
        if self.last.exists():
            last = max(last, self.last.get()[0])
        self.last.update((int(last),))
        self.handle.registerTimer(max(int(last) // 1000 + self.silent_ms, now + 1))
        yield from self._release(key, [*map(tuple, self.waiting.get()), *new], now)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        over = not self.last.exists() or now >= self.last.get()[0] // 1000 + self.silent_ms
        yield from self._release(key, [*map(tuple, self.waiting.get())], None if over else now)
        if over:
            for state in (self.waiting, self.held, self.last):
                state.clear()

    def close(self) -> None:
        pass


def with_recording(rows: DataFrame) -> DataFrame:
    """``rows`` with a recording_id; without one, rows are one recording of their device."""
    own = F.coalesce("recording_id", F.lit("")) if "recording_id" in rows.columns else F.lit("")
    return rows.withColumn("recording_id", own).withColumn("device_id", F.coalesce("device_id", F.lit("")))


def milliseconds(spark: SparkSession, interval: str) -> int:
    """An interval such as ``10 minutes`` in milliseconds."""
    return int(spark.range(1).select((F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {interval}")) / 1000).cast("long")).first()[0])


def in_order(rows: DataFrame, columns: str, state: str, fold: Fold, out: str, late: str, silent: str) -> DataFrame:
    """Streaming ``rows`` (device_id, recording_id if any, dt_utc and ``columns``, which begin with ``us long, chunk_id long``) through ``fold``.

    Rows more than ``late`` behind the newest are dropped, as Spark drops them;
    a recording ends ``silent`` after its last row.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # the store that has timers
    names = [c.split()[0] for c in columns.split(", ")]
    timed = with_recording(rows).withWatermark("dt_utc", late).withColumn("us", F.unix_micros("dt_utc"))
    keyed = timed.select(*KEYS, "dt_utc", *names).groupBy(*KEYS)
    return keyed.transformWithStateInPandas(InOrder(columns, state, fold, milliseconds(spark, silent)), f"device_id string, recording_id string, {out}", "Append", "EventTime")
