"""A table of events laid out by recording: one folder each, so recordings come and go without a look at the others.

Appending and replacing write the partitions of their own rows only; deleting
drops folders and reads no rows.  A recording that is still being written is
never dropped.
"""

from __future__ import annotations

from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAME = "recording"
#: Fixed value: recordings that one request deletes.
MOST = 64


def _named(events: DataFrame) -> DataFrame:
    """``events`` with the recording's name as a column: that of its file, else its id."""
    own = [F.col(c) for c in ("source_file", "recording_id") if c in events.columns]
    return events.withColumn(NAME, F.coalesce(*own, F.lit("none")))


def append(events: DataFrame, path: str) -> None:
    """Add events; rows of a recording lie together in one file of each write."""
    _named(events).repartition(NAME).write.partitionBy(NAME).mode("append").parquet(path)


def replace(events: DataFrame, path: str) -> None:
    """Put events in the place of their recordings; other recordings stay untouched."""
    _named(events).repartition(NAME).write.partitionBy(NAME).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str, names: Iterable[str] | None = None) -> DataFrame:
    """Events of all recordings or of some: a filter on the name lists only their folders."""
    out = spark.read.option("basePath", path).parquet(path)
    return out if names is None else out.filter(F.col(NAME).isin(*names))


def being_written(events: DataFrame, seconds: float = 60.0, now: str | None = None) -> set[str]:
    """Names of recordings whose last event is no older than ``seconds``."""
    at = F.current_timestamp() if now is None else F.to_timestamp(F.lit(now))
    last = events.groupBy(NAME).agg(F.max("dt_utc").alias("last"))
    return {r[0] for r in last.filter(F.unix_micros(at) - F.unix_micros("last") <= seconds * 1e6).select(NAME).collect()}  # recordings in progress: one a device


def delete(spark: SparkSession, path: str, names: Iterable[str], writing: Iterable[str] = ()) -> dict[str, list[str]]:
    """Drop recordings by name: which are deleted, which are being written and stay, and which aren't there. More than MOST are an error."""
    wanted, busy = list(dict.fromkeys(names)), set(writing)
    if not 1 <= len(wanted) <= MOST:
        raise ValueError(f"name 1 to {MOST} recordings")
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = top.getFileSystem(spark._jsc.hadoopConfiguration())
    folders = {}
    for status in store.listStatus(top) if store.exists(top) else ():
        key, _, name = status.getPath().getName().partition("=")
        if key == NAME:
            folders[unquote(name)] = status.getPath()
    out: dict[str, list[str]] = {"deleted": [], "writing": [], "missing": []}
    for name in wanted:
        kind = "writing" if name in busy else "deleted" if name in folders else "missing"
        if kind == "deleted":
            store.delete(folders[name], True)
        out[kind].append(name)
    return out
