"""Raw samples as a source, for batch and streams: chunks of a fixed length from files that grow.

A recording is a file ``<device>__<start>.raw`` of little-endian 32-bit samples,
its start as in a recording's name (``2026-01-15T12-00-00Z``).  An offset holds
how many whole chunks each file had; a batch is the chunks between two offsets,
cut into ranges that tasks read apart, so a chunk is read once, in order within
its recording, also after a restart.  What doesn't fill a chunk waits.

Files are reached through pyarrow's file systems: a local path or a URI of a
store that it knows.
"""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

CHUNK = 46_800
RATE = 48_000
WIDTH = 4
#: Chunks that a task reads.
RANGE = 64
_NAME = re.compile(r"(.+)__(\d{4}-\d\d-\d\dT\d\d-\d\d-\d\dZ)\.raw")
SCHEMA = "device_id string, recording_id string, dt_utc timestamp, chunk_id long, chunk_index int, samples array<int>"


def started(recording: str) -> dt.datetime:
    return dt.datetime.strptime(recording, "%Y-%m-%dT%H-%M-%SZ").replace(tzinfo=dt.UTC)


class Stretch(InputPartition):
    """Chunks [first, last) of a file."""

    def __init__(self, path: str, first: int, last: int) -> None:
        self.path, self.first, self.last = path, first, last


class _Folder:
    """The files of a folder, their whole chunks, and how to read them."""

    def __init__(self, options: dict) -> None:
        self.uri, self.chunk = options["path"], int(options.get("chunk", CHUNK))
        self.range = int(options.get("range", RANGE))

    def sizes(self) -> dict[str, int]:
        """Whole chunks of each file, by path."""
        store, at = pa.fs.FileSystem.from_uri(self.uri) if "://" in self.uri else (pa.fs.LocalFileSystem(), self.uri)
        found = store.get_file_info(pa.fs.FileSelector(at, recursive=True, allow_not_found=True))
        return {f.path: f.size // (WIDTH * self.chunk) for f in found if f.is_file and _NAME.fullmatch(f.base_name)}

    def stretches(self, start: dict[str, int], end: dict[str, int]) -> list[Stretch]:
        return [Stretch(p, k, min(k + self.range, n)) for p, n in sorted(end.items()) for k in range(start.get(p, 0), n, self.range)]

    def read(self, part: Stretch | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # a folder without whole chunks
            return
        store = pa.fs.FileSystem.from_uri(self.uri)[0] if "://" in self.uri else pa.fs.LocalFileSystem()
        device, recording = _NAME.fullmatch(part.path.rsplit("/", 1)[-1]).groups()
        begin = started(recording)
        with store.open_input_file(part.path) as f:
            for k in range(part.first, part.last):  # a chunk at a time is in memory
                raw = f.read_at(WIDTH * self.chunk, WIDTH * self.chunk * k)
                samples = pa.ListArray.from_arrays(pa.array([0, self.chunk], pa.int32()), pa.array(np.frombuffer(raw, "<i4")))
                at = begin + dt.timedelta(seconds=k * self.chunk / RATE)
                yield pa.RecordBatch.from_arrays([pa.array([device]), pa.array([recording]), pa.array([at], pa.timestamp("us", "UTC")), pa.array([k]), pa.array([k], pa.int32()), samples], names=["device_id", "recording_id", "dt_utc", "chunk_id", "chunk_index", "samples"])


class _Batch(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder = _Folder(options)

    def partitions(self) -> list[Stretch]:
        return self.folder.stretches({}, self.folder.sizes())

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        return self.folder.read(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.folder = _Folder(options)

    def initialOffset(self) -> dict:
        return {"chunks": json.dumps({})}

    def latestOffset(self) -> dict:
        return {"chunks": json.dumps(self.folder.sizes(), sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        return self.folder.stretches(json.loads(start["chunks"]), json.loads(end["chunks"]))

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        return self.folder.read(partition)

    def commit(self, end: dict) -> None:
        pass


class RawSamples(DataSource):
    """Options: ``path``, and ``chunk``, the samples of a chunk, and ``range``, the chunks of a task."""

    @classmethod
    def name(cls) -> str:
        return "rawsamples"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make ``spark.read.format("rawsamples")`` and ``spark.readStream.format("rawsamples")`` known."""
    spark.dataSource.register(RawSamples)
