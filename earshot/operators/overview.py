"""Summaries of single recordings and slim points for charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.acoustics import CHUNK_SECONDS, leq, percentile, round_to
from ..sources.events import parse_created


def summary(chunks: DataFrame, loud: float = 65.0, keys: tuple[str, ...] = ("device_id",)) -> DataFrame:
    """Levels, loud rows and gating of each recording; gated rows never count as open.

    Seconds are from the first to the last time, one for a single row, and
    follow from the number of rows where a time is missing.
    """
    loud = min(max(loud, 50.0), 80.0)
    n = F.count("*")
    peaks = F.count("lafmax")
    loud_n = F.count_if(F.col("lafmax") >= loud)
    timed = F.floor((F.unix_micros(F.max("dt_utc")) - F.unix_micros(F.min("dt_utc"))) / F.lit(1e6))
    share = lambda c: round_to(F.lit(100.0) * c / n)
    opened = F.coalesce(F.col("gate_open"), F.lit(False)) if "gate_open" in chunks.columns else F.lit(False)
    return chunks.groupBy(*keys).agg(
        n.alias("chunks"), round_to(F.avg("dba")).alias("mean_dba"), percentile(F.col("dba"), 50).alias("l50_db"), percentile(F.col("dba"), 90).alias("l10_db"), percentile(F.col("dba"), 10).alias("l90_db"),
        leq(F.col("dba")).alias("leq_db"), round_to(F.avg("lafmax")).alias("mean_lafmax"), F.max("lafmax").alias("max_lafmax"), loud_n.alias("loud_chunks"),
        F.when(peaks > 0, round_to(F.lit(100.0) * loud_n / peaks)).otherwise(F.lit(0.0)).alias("loud_pct"),
        share(F.count_if("gated")).alias("gated_pct"), share(F.count_if(~F.col("gated") & opened)).alias("gate_open_pct"), F.count_if(~F.col("gated") & F.col("top_label").isNotNull()).alias("classified"),
        F.when(n == 1, F.lit(1)).when(F.count("dt_utc") < n, F.bround((n - 1) * F.lit(CHUNK_SECONDS))).otherwise(timed).cast("long").alias("duration_s"),
    )


def heavy_model(captured: Column, detected: Column) -> Column:
    """Which heavy model a recording ran: the detector, if any row has it, else the captures' classifier."""
    return F.when(F.bool_or(detected), "dasm").when(F.bool_or(captured), "clap").otherwise("off")


def identity(events: DataFrame, keys: tuple[str, ...] = ("source_file",)) -> DataFrame:
    """Of each recording its first device and recording id, its bounds, and its heavy model."""
    at = F.struct("dt_utc", "chunk_id")
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), at))
    return events.groupBy(*keys).agg(
        first(F.col("device_id")).alias("first_device"), first(F.col("recording_id")).alias("first_recording"), F.min("dt_utc").alias("started_at"), F.max("dt_utc").alias("ended_at"),
        heavy_model(F.col("clap_status").isNotNull(), F.col("dasm").isNotNull()).alias("heavy_ml"),
    )


def top_labels(chunks: DataFrame, most: int = 8) -> DataFrame:
    """The commonest labels of rows that aren't gated; of equals the first seen."""
    rows = chunks.filter(~F.col("gated") & F.col("top_label").isNotNull())
    per = rows.groupBy("top_label").agg(F.count("*").alias("rows"), F.min(F.struct("dt_utc", "chunk_id")).alias("first"))
    return per.orderBy(F.col("rows").desc(), "first").limit(most).select("top_label", "rows")


def label_lists(events: DataFrame, keys: tuple[str, ...] = ("source_file",), most: int = 8) -> DataFrame:
    """Of each recording the commonest labels of the classifier, of captures and of the detector: (keys, kind, place, label, rows).

    One scan: a row explodes into the labels that it counts for.
    """
    label = F.when(~F.col("gated") & (F.col("top_label") != "gated"), F.col("top_label"))
    many = F.filter(F.transform("dasm.labels", lambda x: x["label"]), lambda x: x.isNotNull() & (x != ""))
    detected = F.when(F.col("dasm.status") == "triggered", F.when(F.size(many) > 0, many).otherwise(F.array("dasm.top_label")))
    one = lambda kind, c: F.transform(c, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("label")))
    empty = F.array().cast("array<struct<kind:string,label:string>>")
    every = F.concat(one("yamnet", F.array(label)), one("clap", F.array(F.when(F.col("clap_status") == "triggered", F.col("clap_top_label")))), F.coalesce(one("dasm", detected), empty))
    rows = events.select(*keys, F.struct("dt_utc", "chunk_id").alias("at"), F.explode(every).alias("l")).select(*keys, "at", "l.*").filter("label IS NOT NULL AND label <> ''")
    per = rows.groupBy(*keys, "kind", "label").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    place = F.row_number().over(Window.partitionBy(*keys, "kind").orderBy(F.col("rows").desc(), "first", "label"))
    return per.withColumn("place", place).filter(F.col("place") <= most).select(*keys, "kind", "place", "label", "rows")


def multilabel_counts(events: DataFrame) -> DataFrame:
    """Labels of triggered window classifications: all labels of a row that has several, else its top one."""
    hit = events.filter("dasm.status = 'triggered'")
    many = hit.select(F.explode_outer("dasm.labels").alias("l"), F.col("dasm.top_label").alias("top"))
    return many.select(F.coalesce("l.label", "top").alias("label")).filter("label IS NOT NULL AND label <> ''").groupBy("label").agg(F.count("*").alias("rows"))


def slim_points(events: DataFrame, offset: float = 0.0) -> DataFrame:
    """The columns of a chart point, levels shifted by an offset of 40 dB at most."""
    offset = min(max(offset, -40.0), 40.0)
    shift = lambda c: round_to(F.col(c) + F.lit(offset))
    prep = F.col("yamnet_preprocess")
    gated = F.coalesce(prep["gated"], F.lit(False)) | F.coalesce(F.col("top_label") == "gated", F.lit(False))
    sure = lambda sp: F.struct(sp["t0_s"].alias("t0_s"), sp["t1_s"].alias("t1_s"), F.coalesce(sp["confidence"], F.lit(0.0)).alias("confidence"))
    spans = lambda x: F.transform(F.filter(x["spans"], lambda sp: sp["t0_s"].isNotNull() & sp["t1_s"].isNotNull()), sure)
    named = F.filter("dasm.labels", lambda x: x["label"].isNotNull() & (x["label"] != ""))
    labels = F.when(F.col("dasm.status") == "triggered", F.transform(named, lambda x: F.struct(x["label"].alias("label"), x["clip_confidence"].alias("clip_confidence"), spans(x).alias("spans"))))
    energy = F.col("spectrum.a.energy_pct")
    return events.filter("created_at IS NOT NULL").select(
        "source_file", "created_at", (F.unix_micros(parse_created(F.col("created_at"))) / 1000).alias("ms"), shift("dBA_spl").alias("dba"), shift("LAFmax_dB").alias("lafmax"),
        round_to(prep["ambient_noise_floor_dbfs"] + prep["calibration_offset_db"]).alias("l90_rel"), gated.alias("gated"), (F.coalesce(prep["gate_open"], F.lit(False)) & ~gated).alias("gate_open"),
        "top_label", "top_confidence", "clap_status", "clap_top_label", "clap_top_confidence", F.coalesce("clap_meta.event_seconds", "clap_meta.window_seconds").alias("event_seconds"),
        F.col("dasm.status").alias("dasm_status"), F.col("dasm.top_label").alias("dasm_top_label"), F.col("dasm.top_confidence").alias("dasm_top_confidence"), F.col("dasm.event_seconds").alias("dasm_event_seconds"), labels.alias("dasm_labels"), F.col("spectrum.a.centroid_hz").alias("centroid_hz"), F.when(energy.isNotNull(), F.struct(energy["low"].alias("dark"), energy["mid"].alias("mid"), energy["high"].alias("bright"))).alias("spectrum_bands"),
    )


def markers(points: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """Points of triggered captures with a label and a level."""
    sure = F.col("clap_top_confidence").isNull() | (F.col("clap_top_confidence") >= min_confidence)
    ok = (F.col("clap_status") == "triggered") & F.col("clap_top_label").isNotNull() & F.col("dba").isNotNull() & sure
    return points.filter(ok).select("source_file", "ms", "dba", F.col("clap_top_label").alias("label"), F.col("clap_top_confidence").alias("confidence"), F.when(F.col("event_seconds") > 0, F.col("event_seconds")).alias("event_seconds"))


def detector_markers(points: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """The same for the window detector, with all labels of a point."""
    sure = F.col("dasm_top_confidence").isNull() | (F.col("dasm_top_confidence") >= min_confidence)
    ok = (F.col("dasm_status") == "triggered") & F.col("dasm_top_label").isNotNull() & F.col("dba").isNotNull() & sure
    seconds = F.when(F.col("dasm_event_seconds") > 0, F.col("dasm_event_seconds"))
    return points.filter(ok).select("source_file", "ms", "dba", F.col("dasm_top_label").alias("label"), F.col("dasm_top_confidence").alias("confidence"), seconds.alias("event_seconds"), F.col("dasm_labels").alias("labels"))
