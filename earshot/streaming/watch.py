"""Watching streams: a line of progress for each recording, metrics of a query, and a rolling table of the last minutes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQueryListener

#: Events between two lines.
EVERY = 60
#: Seconds of a slot of the rolling table, and slots' seconds that it keeps.
SLOT_S, KEEP_S = 60, 900


class _Progress(StatefulProcessor):
    """Counts of a recording, and a line each EVERY events."""

    def __init__(self, every: int) -> None:
        self.every = every

    def init(self, handle: Any) -> None:
        self.held = handle.getValueState("held", "events long, gated long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        events, gated = (int(v) for v in self.held.get()) if self.held.exists() else (0, 0)
        found = []
        some = pd.concat(list(rows)).sort_values("chunk_index")  # a recording's events of one batch, four small columns
        for index, label in zip(some["chunk_index"], some["top_label"]):
            events, gated = events + 1, gated + (label == "gated")
            if events % self.every == 0:
                found.append((*key, events, int(index), label, gated, f"{events} events of {key[1]} (last {int(index)}, {label}; {gated} gated)"))
        self.held.update((events, gated))
        yield pd.DataFrame(found, columns=["device_id", "recording_id", "events", "chunk_index", "top_label", "gated", "line"])

    def close(self) -> None:
        pass


def progress(events: DataFrame, every: int = EVERY) -> DataFrame:
    """Streaming events (device_id, recording_id, chunk_index, top_label) to one row with a line for each ``every`` events of a recording."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    keyed = events.select("device_id", "recording_id", "chunk_index", "top_label").groupBy("device_id", "recording_id")
    out = "device_id string, recording_id string, events long, chunk_index int, top_label string, gated long, line string"
    return keyed.transformWithStateInPandas(_Progress(every), out, "Append", "None")


def observed(events: DataFrame, name: str = "events") -> DataFrame:
    """``events`` with metrics of each batch: how many, how many gated, and the last time; no second pass over the rows."""
    return events.observe(name, F.count(F.lit(1)).alias("events"), F.count_if(F.col("top_label") == "gated").alias("gated"), F.max("created_at").alias("last"))


class Totals(StreamingQueryListener):
    """Sums of what ``observed`` reports, by query, on the driver."""

    def __init__(self, name: str = "events") -> None:
        self.name, self.totals = name, {}

    def onQueryStarted(self, event: Any) -> None:
        pass

    def onQueryProgress(self, event: Any) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            events, gated, last = self.totals.get(event.progress.id, (0, 0, None))
            self.totals[event.progress.id] = (events + row["events"], gated + row["gated"], max(filter(None, (last, row["last"])), default=None))

    def onQueryTerminated(self, event: Any) -> None:
        pass


def roll(events: DataFrame, path: str, checkpoint: str, keep_s: int = KEEP_S):
    """A streaming query that keeps the last ``keep_s`` seconds of events (dt_utc) as a table of slots.

    A batch writes the slots that it touches under its own number, so one that
    runs twice replaces what it wrote; slots that are too old are dropped as
    folders.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        slots = batch.withColumn("slot", F.floor(F.unix_seconds("dt_utc") / SLOT_S)).withColumn("batch", F.lit(number))
        slots.repartition("slot").write.partitionBy("slot", "batch").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
        top = spark._jvm.org.apache.hadoop.fs.Path(path)
        store = top.getFileSystem(spark._jsc.hadoopConfiguration())
        found = {int(s.getPath().getName()[5:]): s.getPath() for s in store.listStatus(top) if s.getPath().getName().startswith("slot=")}
        for slot, folder in found.items():
            if slot < max(found) - -(-keep_s // SLOT_S):
                store.delete(folder, True)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_seconds(spark: SparkSession, path: str, seconds: int = 120) -> DataFrame:
    """Events of the last ``seconds`` (60 to 900) before the newest: only the slots that these reach into are read."""
    w = min(max(seconds, 60), 900)
    table = spark.read.parquet(path)
    newest = table.agg(F.max("slot")).first()[0]  # from the folders' names
    if newest is None:
        return table
    near = table.filter(F.col("slot") >= newest - w // SLOT_S - 1)
    end = near.agg(F.max("dt_utc").alias("end"))
    return near.crossJoin(end).filter(F.unix_micros("end") - F.unix_micros("dt_utc") <= w * 1_000_000).drop("end", "slot", "batch")  # one row
