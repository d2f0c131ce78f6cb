"""Audio files: recordings written as 16-bit WAV or FLAC by executors, and the sample count in a FLAC header.

The writer is a data source: each task writes its recordings under hidden names,
the driver's commit gives them their own, and an abort takes away what a job
left.  A file's header needs its number of samples, which an aggregate knows
before, so samples stream through a task from chunk to chunk.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from . import flac


KINDS = ("wav", "flac")


def audio_kind(raw: object, default: str = "flac") -> str:
    """A kind of file by its name, whatever its case; the default where there is none or another."""
    text = str(raw or default).strip().lower()
    return text if text in KINDS else default


def audio_suffix(raw: object) -> str:
    return "." + audio_kind(raw)


def to_pcm16(x: np.ndarray) -> np.ndarray:
    """Floats to 16-bit integers, clipped."""
    return (np.clip(np.asarray(x, np.float64), -1.0, 1.0) * 32767.0).astype("<i2")


def _store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri) if "://" in uri else (pyarrow.fs.LocalFileSystem(), uri)


class Written(WriterCommitMessage):
    """Files of a task: hidden names and those they get."""

    def __init__(self, files: list[tuple[str, str]]) -> None:
        self.files = files


class _Recordings(DataSourceWriter):
    """Rows (name, total, pcm), those of a name together and in order, to a file for each name."""

    def __init__(self, options: dict) -> None:
        self.uri, self.kind, self.rate = options["path"], options.get("kind", "flac"), int(options.get("rate", 48_000))
        if self.kind not in KINDS:
            raise ValueError(f"kind is one of {', '.join(KINDS)}")
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Written:
        store, at = _store(self.uri)
        store.create_dir(at, recursive=True)
        name, out, encoder, files = None, None, None, []

        def end() -> None:
            if out is not None:
                out.write(encoder.add(np.zeros(0), end=True) if self.kind == "flac" else b"")
                out.close()

        try:
            for row in iterator:
                if row["name"] != name:
                    end()
                    name, encoder = row["name"], flac.Encoder()
                    hidden = f"{at}/.{name}.{self.job}-{uuid.uuid4().hex}"
                    files.append((hidden, f"{at}/{name}.{self.kind}"))
                    out = store.open_output_stream(hidden)
                    out.write((flac.header if self.kind == "flac" else flac.wav_header)(row["total"], self.rate))
                x = to_pcm16(np.asarray(row["pcm"], float))
                out.write(encoder.add(x) if self.kind == "flac" else x.tobytes())
            end()
        except BaseException:
            if out is not None:
                out.close()
            raise
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, _ = _store(self.uri)
        for hidden, name in (f for m in messages if m is not None for f in m.files):
            store.move(hidden, name)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """What tasks of this job left that failed or ran twice."""
        store, at = _store(self.uri)
        for f in store.get_file_info(pyarrow.fs.FileSelector(at, allow_not_found=True)):
            if f".{self.job}-" in f.base_name:
                store.delete_file(f.path)


class RecordingFiles(DataSource):
    """Options: ``path``, ``kind`` (flac or wav) and ``rate``."""

    @classmethod
    def name(cls) -> str:
        return "recordingfiles"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Recordings(dict(self.options))


def write_recordings(pcm: DataFrame, path: str, kind: str = "flac", rate: int = 48_000, chunks_per_file: int = 1 << 14) -> None:
    """Chunks (device_id, recording_id, chunk_index, pcm) to a file for each recording.

    A recording longer than ``chunks_per_file`` goes on in files with a number,
    so no task writes more than that.  Names are made safe; what is null or empty is called none.
    """
    pcm.sparkSession.dataSource.register(RecordingFiles)
    part = F.floor(F.col("chunk_index") / chunks_per_file)
    safe = lambda c: F.regexp_replace(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("none")), "[^A-Za-z0-9.-]", "-")
    tail = F.when(part > 0, F.concat(F.lit("."), part.cast("string"))).otherwise("")
    named = pcm.select(F.concat(safe("device_id"), F.lit("__"), safe("recording_id"), tail).alias("name"), "chunk_index", F.coalesce("pcm", F.array().cast("array<double>")).alias("pcm"))
    totals = named.groupBy("name").agg(F.sum(F.size("pcm")).alias("total"))
    rows = named.join(totals, "name").repartition("name").sortWithinPartitions("name", "chunk_index")
    rows.select("name", "total", "pcm").write.format("recordingfiles").mode("append").option("path", path).option("kind", kind).option("rate", rate).save()


def flac_samples(header: bytes) -> int | None:
    """The 36-bit number of samples in the first block of a FLAC file, None where it isn't one."""
    if len(header) < 26 or header[:4] != b"fLaC" or header[4] & 0x7F:
        return None
    return struct.unpack(">Q", header[18:26])[0] & ((1 << 36) - 1)


def patch_flac_samples(header: bytes, samples: int) -> bytes:
    """The header with another number of samples."""
    if flac_samples(header) is None or not 0 <= samples < 1 << 36:
        raise ValueError("not a FLAC header, or too many samples")
    word = struct.unpack(">Q", header[18:26])[0]
    return header[:18] + struct.pack(">Q", (word >> 36 << 36) | samples) + header[26:]


def flac_samples_column(content: Column) -> Column:
    """The same over a binary column, in SQL: five bytes of the header, the upper half of the first masked."""
    low = F.conv(F.hex(F.substring(content, 22, 5)), 16, 10).cast("long")
    return F.when(F.hex(F.substring(content, 1, 4)) == "664C6143", low.bitwiseAND(F.lit((1 << 36) - 1)))


def audio_files(spark: SparkSession, path: str) -> DataFrame:
    """name, bytes, modified and, for FLAC, samples of audio files; contents aren't kept."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), flac_samples_column(F.col("content")).alias("samples"))
