"""Telemetry events: tolerant JSON Lines, tables of chunks, listings and exports."""

from __future__ import annotations

from datetime import datetime
from zoneinfo import ZoneInfo

import pandas as pd
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.acoustics import CHUNK_SECONDS, round_to
from ..functions.text import duration_label, utc_iso

PREDICTION = "struct<label:string,confidence:double>"
#: The columns of a stored event that analyses read.
EVENT_DDL = (
    "device_id string, created_at string, chunk_index int, recording_id string, run_id string, rms_unweighted double, rms_a_weighted double, "
    f"dBA_spl double, LAFmax_dB double, top_label string, top_confidence double, predictions array<{PREDICTION}>, model_name string, model_version string, "
    "yamnet_preprocess struct<gated:boolean,gate_open:boolean,ambient_noise_floor_dbfs:double,calibration_offset_db:double,raw_rms_dbfs:double>, "
    "spectrum struct<band_type:string,centers_hz:array<double>,a:struct<levels_db:array<double>,centroid_hz:double,rolloff_85_hz:double,energy_pct:struct<low:double,mid:double,high:double>>>, "
    f"clap_status string, clap_predictions array<{PREDICTION}>, clap_top_label string, clap_top_confidence double, clap_meta struct<event_seconds:double,window_seconds:double,trigger_reason:string>, "
    "dasm struct<status:string,event_seconds:double,top_label:string,top_confidence:double,labels:array<struct<label:string,clip_confidence:double,spans:array<struct<t0_s:double,t1_s:double,confidence:double>>>>>"
)


def _read(spark: SparkSession, paths: str | list[str], names: dict[str, T.DataType], raw: bool) -> DataFrame:
    """Lines that are objects, with ``names`` out of each; nothing else of a line is made into columns."""
    lines = spark.read.text(paths).select(F.col("value").alias("raw"), F.col("_metadata.file_name").alias("source_file")).filter(F.trim("value") != "")
    parsed = lines.withColumn("_v", F.try_parse_json("raw")).filter(F.expr("schema_of_variant(_v) LIKE 'OBJECT%'"))
    string = lambda k: F.expr(f"CASE WHEN schema_of_variant(variant_get(_v, '$.{k}', 'variant')) = 'STRING' THEN variant_get(_v, '$.{k}', 'string') END")
    cols = [(string(k) if isinstance(kind, T.StringType) else F.expr(f"try_variant_get(_v, '$.{k}', '{kind.simpleString()}')")).alias(k) for k, kind in names.items()]
    return parsed.select("source_file", *(["raw"] if raw else []), *cols)


def read_jsonl(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Events with ``source_file`` and the raw line; blank and malformed lines are skipped.

    Numbers stored as strings parse too, and a string field counts only where it
    is a string, as a variant tells.
    """
    return _read(spark, paths, {f.name: f.dataType for f in T.StructType.fromDDL(EVENT_DDL).fields}, True)


#: Columns that a report reads.
REPORT_COLUMNS = ("device_id", "created_at", "dBA_spl", "LAFmax_dB", "top_label", "top_confidence", "yamnet_preprocess", "clap_status")


def read_for_report(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The columns of a report alone, from the lines that ``read_jsonl`` keeps and by its rules; spectra and the like are never made."""
    kinds = {f.name: f.dataType for f in T.StructType.fromDDL(EVENT_DDL).fields}
    kinds["yamnet_preprocess"] = T.StructType.fromDDL("gated boolean")
    return _read(spark, paths, {c: kinds[c] for c in REPORT_COLUMNS}, False)


def parse_created(created: Column) -> Column:
    """ISO-8601 to a timestamp; without a zone it is UTC, malformed is null."""
    return F.try_to_timestamp(F.trim(created))


def recording_id() -> Column:
    """The recording, or the key that older files have."""
    return F.coalesce(F.nullif(F.col("recording_id"), F.lit("")), F.nullif(F.col("run_id"), F.lit("")))


def chunks_from_events(events: DataFrame, zone: str = "Europe/Amsterdam", offset: float = 0.0) -> DataFrame:
    """Rows with a level and a parseable time; gated ones stay."""
    shifted = (lambda c: round_to(c + F.lit(offset))) if offset else (lambda c: c)
    out = events.withColumn("dt_utc", parse_created(F.col("created_at"))).filter(F.col("dt_utc").isNotNull() & F.col("dBA_spl").isNotNull())
    return out.select(
        F.monotonically_increasing_id().alias("chunk_id"), "dt_utc", F.from_utc_timestamp("dt_utc", zone).alias("dt_local"), "device_id", "source_file",
        shifted(F.col("dBA_spl")).alias("dba"), shifted(F.col("LAFmax_dB")).alias("lafmax"), "top_label", "top_confidence",
        (F.coalesce(F.col("yamnet_preprocess.gated"), F.lit(False)) | F.coalesce(F.col("top_label") == "gated", F.lit(False))).alias("gated"), "clap_status",
    )


def chunks(spark: SparkSession, sf_dir: str, zone: str = "Europe/Amsterdam") -> DataFrame:
    """The table ``events`` as acoustic chunks: eight devices, levels of 30 to 90 dBA."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    level = round_to(F.lit(30.0) + F.least("value", F.lit(120.0)) * F.lit(0.5))
    label = F.when(F.col("event_type") == "view", "Speech").when(F.col("event_type") == "click", "Vehicle").when(F.col("event_type") == "purchase", "Wind").when(F.col("event_type") == "signup", "Bird").otherwise("gated")
    device = F.concat(F.lit("dev-"), (F.col("user_id") % 8).cast("string"))
    out = e.select(
        F.col("event_id").alias("chunk_id"), F.col("ts").cast("timestamp").alias("dt_utc"), device.alias("device_id"), level.alias("dba"), (level + F.lit(3.0)).alias("lafmax"),
        label.alias("top_label"), ((F.col("event_id") % 100).cast("double") / F.lit(100.0)).alias("top_confidence"), F.coalesce(F.col("event_type") == "error", F.lit(False)).alias("gated"),
    )
    return out.withColumn("dt_local", F.from_utc_timestamp("dt_utc", zone)).withColumn("source_file", F.concat("device_id", F.lit(".jsonl"))).withColumn("clap_status", F.lit(None).cast("string"))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same chunks with the fields of gate, captures and detector, made from the table's columns."""
    c = chunks(spark, sf_dir)
    i = F.col("chunk_id")
    captured = F.when(i % 5 == 0, F.when(F.col("gated"), "gated").otherwise("triggered"))
    detected = F.when(
        i % 7 == 0,
        F.struct(
            F.when(F.col("gated"), "gated").otherwise("triggered").alias("status"), F.lit(10.0).alias("event_seconds"), F.col("top_label"), F.col("top_confidence"),
            F.when(i % 2 == 0, F.array(*[F.struct(F.lit(n).alias("label"), F.col("top_confidence").alias("clip_confidence")) for n in ("Car", "Wind")])).alias("labels"),
        ),
    )
    out = c.withColumn("gate_open", ~F.col("gated") & (i % 3 != 0)).withColumn("clap_status", captured).withColumn("clap_top_label", F.when(captured == "triggered", F.concat(F.lit("a "), F.lower("top_label"))))
    out = out.withColumn("dasm", detected).withColumn("recording_id", F.concat(F.col("device_id"), F.lit("-r")))
    from ..operators.segment import numbered

    return numbered(out, ["source_file"]).withColumn("chunk_index", (F.col("rn") - 1).cast("int")).drop("rn", "n", "_slice")


def bounds(events: DataFrame, order: Column | None = None) -> DataFrame:
    """First and last event of each recording as structs, by time where no order is given."""
    order = F.struct("dt_utc", "chunk_id") if order is None else order
    whole = F.struct(*[c for c in events.columns if c != "source_file"])
    return events.groupBy("source_file").agg(F.min_by(whole, order).alias("first"), F.max_by(whole, order).alias("last"))


def recordings(events: DataFrame) -> DataFrame:
    """A row for each file: lines, first and last time, seconds, and which heavy model ran."""
    t = parse_created(F.col("created_at"))
    heavy = F.when(F.bool_or(F.col("dasm").isNotNull()), "dasm").when(F.bool_or(F.col("clap_status").isNotNull()), "clap").otherwise("off")
    return events.groupBy("source_file").agg(F.count("*").alias("lines"), F.min(t).alias("started"), F.max(t).alias("ended"), (F.count("*") * F.lit(CHUNK_SECONDS)).alias("seconds"), heavy.alias("heavy_ml"))


def catalog(events: DataFrame, files: DataFrame | None = None, zone: str = "Europe/Amsterdam") -> DataFrame:
    """Recordings, newest first: lines, start (local, with the zone's name), seconds, heavy model, and size and audio of ``files``.

    ``events`` has source_file, chunk_index, dt_utc, clap_status and dasm; the
    last chunk_index counts lines where it is known.  ``files`` is (name, bytes,
    modified) of the folder, audio files too.
    """
    heavy = F.when(F.bool_or(F.col("dasm").isNotNull()), "dasm").when(F.bool_or(F.col("clap_status").isNotNull()), "clap").otherwise("off")
    last = F.max_by("chunk_index", "dt_utc")
    per = events.groupBy(F.col("source_file").alias("name")).agg(F.count("*").alias("rows"), last.alias("last_index"), F.min("dt_utc").alias("started"), F.max("dt_utc").alias("ended"), heavy.alias("heavy_ml"))
    if files is None:
        per = per.withColumns({"bytes": F.lit(None).cast("long"), "modified": F.col("ended"), "audio": F.lit(None).cast("string")})
    else:
        per = with_audio(files.filter(F.lower("name").endswith(".jsonl")).join(per, "name", "left"), files.select("name"))
    lines = F.coalesce(F.when(F.col("last_index") >= 0, F.col("last_index") + 1), F.col("rows"), F.lit(0)).cast("long")
    seconds = F.floor((F.unix_micros("ended") - F.unix_micros("started")) / F.lit(1e6))
    seconds = F.when((seconds == 0) & (lines >= 1), 1).otherwise(seconds).cast("long")
    start = F.from_utc_timestamp(F.coalesce("started", "modified"), zone)
    # Summer time moves the local clock; the zone's offset tells its name.
    offset = F.unix_seconds(start) - F.unix_seconds(F.coalesce("started", "modified"))
    name = F.format_string("UTC%+d", (offset / 3600).cast("int"))
    for at in (datetime(2024, 1, 1, tzinfo=ZoneInfo(zone)), datetime(2024, 7, 1, tzinfo=ZoneInfo(zone))):
        name = F.when(offset == int(at.utcoffset().total_seconds()), at.tzname()).otherwise(name)
    label = F.concat(F.date_format(start, "yyyy-MM-dd HH:mm"), F.lit(" "), name)
    out = per.select("name", "bytes", lines.alias("lines"), label.alias("started"), seconds.alias("duration_s"), duration_label(seconds).alias("duration"), F.coalesce("heavy_ml", F.lit("off")).alias("heavy_ml"), "audio", "modified")
    return out.orderBy(F.col("modified").desc(), "name")


def status(events: DataFrame, now: Column | None = None) -> DataFrame:
    """A snapshot of each recording in progress: rows so far, last label and level, when it began and how long ago."""
    edge = bounds(events)
    now = F.current_timestamp() if now is None else now
    index = F.col("last.chunk_index")
    return edge.select(
        "source_file", (F.coalesce(index, F.lit(-1)) + 1).cast("long").alias("chunk_count"), F.col("last.top_label").alias("last_label"), F.col("last.dba").alias("last_dba"), F.col("first.dt_utc").alias("started_at"),
        F.floor((F.unix_micros(now) - F.unix_micros("first.dt_utc")) / F.lit(1e6)).cast("long").alias("elapsed_s"), F.coalesce("last.recording_id", "first.recording_id").alias("recording_id"),
    )


def build_events(rows: DataFrame, model: str = "yamnet", version: str = "1") -> DataFrame:
    """Measured rows (levels, predictions and optional structs) as stored events: rounded, with their top label, absent parts left out.

    Null fields are not written to JSON, so optional parts need no other shape.
    """
    top = F.get("predictions", F.lit(0))
    has = set(rows.columns)
    optional = [F.col(c) for c in ("spectrum", "yamnet_preprocess", "clap_status", "clap_predictions", "clap_top_label", "clap_top_confidence", "clap_meta", "dasm") if c in has]
    return rows.select(
        "device_id", utc_iso(F.col("dt_utc")).alias("created_at"), "chunk_index", "recording_id", F.round("rms_unweighted", 8).alias("rms_unweighted"), F.round("rms_a_weighted", 8).alias("rms_a_weighted"),
        F.round("dba", 1).alias("dBA_spl"), F.coalesce(top["label"], F.lit("n/a")).alias("top_label"), F.coalesce(top["confidence"], F.lit(0.0)).alias("top_confidence"), "predictions",
        F.lit(model).alias("model_name"), F.lit(version).alias("model_version"), F.round("lafmax", 1).alias("LAFmax_dB"), *optional,
    )


def export(events: DataFrame, path: str, spectrum: bool = True, gate: bool = True) -> None:
    """JSON Lines with or without the bulky fields."""
    dropped = [c for c, keep in (("spectrum", spectrum), ("yamnet_preprocess", gate)) if not keep]
    events.drop("raw", "source_file", *dropped).write.mode("overwrite").json(path)


def tail(events: DataFrame, seconds: int) -> DataFrame:
    """Rows of the last ``seconds`` (60 to 900) of each device."""
    w = min(max(seconds, 60), 900)
    last = events.groupBy("device_id").agg(F.max("dt_utc").alias("_last"))
    return events.join(last, "device_id").filter(F.col("dt_utc") >= F.col("_last") - F.expr(f"INTERVAL {w} SECONDS")).drop("_last")


def tail_lines(spark: SparkSession, path: str, most: int = 320) -> DataFrame:
    """The last ``most`` lines of each file that aren't blank, oldest first, as (source_file, place, raw).

    A file is read from its end in ever larger parts until it has enough lines,
    so a long recording costs no more than its tail; files are read by executors.
    """

    def run(batches):
        for batch in batches:
            for at in batch["path"]:
                yield pd.DataFrame({"source_file": at.rsplit("/", 1)[-1], "raw": _last_lines(at, most)}).assign(place=lambda d: range(1, len(d) + 1))

    listing = spark.read.format("binaryFile").load(path).select("path")
    return listing.repartition("path").mapInPandas(run, "source_file string, raw string, place int").select("source_file", "place", "raw")


def _last_lines(path: str, most: int, part: int = 1 << 18) -> list[str]:
    store, at = pyarrow.fs.FileSystem.from_uri(path) if ":" in path else (pyarrow.fs.LocalFileSystem(), path)
    with store.open_input_file(at) as f:
        size = f.size()
        while True:
            begin = max(0, size - part)
            lines = [x for x in f.read_at(size - begin, begin).split(b"\n") if x.strip()]
            if begin == 0:
                break
            if len(lines) > most:
                lines = lines[1:]  # the first may be part of a line
                break
            part *= 2
    return [x.decode("utf-8", "replace").rstrip("\r") for x in lines[-most:]] if most > 0 else []


def with_audio(names: DataFrame, audio: DataFrame) -> DataFrame:
    """Recordings with their sibling audio file, FLAC before WAV; both sides have ``name``."""
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    best = audio.withColumn("stem", stem).filter(F.lower("name").rlike(r"\.(flac|wav)$")).groupBy("stem").agg(F.min_by("name", F.when(F.lower("name").endswith(".flac"), 0).otherwise(1)).alias("audio"))
    return names.withColumn("stem", stem).join(best, "stem", "left").drop("stem")
