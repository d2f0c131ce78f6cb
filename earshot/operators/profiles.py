"""Profiles by hour, time budgets and sound diets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.acoustics import CHUNK_SECONDS, LDEN_DAY, LDEN_EVENING, LDEN_NIGHT, is_night, lden, leq, level_percentiles, percentile, round_to
from ..functions.text import gap_label, hour_label
from ..sources.labels import SILENCE, UNCLASSIFIED, LabelMap


def stats() -> list:
    """Levels and gating of a group of chunks."""
    gated = F.count_if("gated")
    return [leq(F.col("dba")).alias("leq_db"), percentile(F.col("dba"), 10).alias("l90_db"), percentile(F.col("dba"), 90).alias("l10_db"), F.count("*").alias("chunks"), gated.alias("gated_chunks"), round_to(F.lit(100.0) * gated / F.count("*")).alias("gated_pct")]


def timeline(chunks: DataFrame, min_seconds: float = 1800.0) -> DataFrame:
    """Levels by local hour, without hours that are covered too little."""
    hours = chunks.groupBy(F.date_trunc("hour", "dt_local").alias("hour")).agg(*stats())
    return hours.filter(F.col("chunks") * F.lit(CHUNK_SECONDS) >= F.lit(min_seconds)).withColumn("period", F.when(is_night(F.hour("hour")), "night").otherwise("day"))


def _gaps(hours: DataFrame) -> DataFrame:
    """One row wherever hours are missing between two of the distinct ``hour``."""
    w = Window.orderBy("hour")  # hours, not chunks: some nine thousand a year
    missing = hours.withColumn("_prev", F.lag("hour").over(w)).withColumn("gap_hours", F.floor((F.unix_seconds("hour") - F.unix_seconds("_prev")) / 3600) - 1).filter("gap_hours > 0")
    return missing.select(F.expr("_prev + INTERVAL 1 HOUR").alias("hour"), F.lit(True).alias("is_gap"), "gap_hours", gap_label(F.col("gap_hours")).alias("gap"))


def with_gaps(hours: DataFrame) -> DataFrame:
    """A timeline with one row more wherever hours are missing between two of its rows."""
    return hours.withColumn("is_gap", F.lit(False)).unionByName(_gaps(hours.select("hour")), allowMissingColumns=True)


def typical_day(chunks: DataFrame) -> DataFrame:
    """24 rows: levels by hour of the day, null where there are none."""
    by = chunks.groupBy(F.hour("dt_local").alias("hour")).agg(*stats())
    every = chunks.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    out = every.join(by, "hour", "left")
    return out.withColumn("chunks", F.coalesce("chunks", F.lit(0))).withColumn("gated_chunks", F.coalesce("gated_chunks", F.lit(0))).withColumn("period", F.when(is_night(F.col("hour")), "night").otherwise("day"))


def category_rank(category: Column, labels: LabelMap = LabelMap()) -> Column:
    """Where a category stands in charts: the configured order, then others by name, silence last."""
    order = [m for m in labels.macros if m != SILENCE]
    order += [] if UNCLASSIFIED in order else [UNCLASSIFIED]
    rank = F.when(category == SILENCE, len(order) + 1).otherwise(len(order))
    for i, m in reversed(list(enumerate(order))):
        rank = F.when(category == m, i).otherwise(rank)
    return rank


def time_budget(voted: DataFrame, keys: list, labels: LabelMap = LabelMap()) -> DataFrame:
    """Seconds and share of each category within groups of ``keys``, and its place among those that the group has."""
    per = voted.groupBy(*keys, "category").agg(F.count("*").alias("chunks"))
    keyed = [c for c in per.columns if c not in ("category", "chunks")]
    whole = Window.partitionBy(*keyed) if keyed else Window.partitionBy()
    place = F.row_number().over(whole.orderBy(category_rank(F.col("category"), labels), "category"))
    return per.select(*keyed, "category", place.alias("place"), "chunks", (F.col("chunks") * F.lit(CHUNK_SECONDS)).alias("seconds"), round_to(F.lit(100.0) * F.col("chunks") / F.sum("chunks").over(whole)).alias("pct"))


def hourly_budget(voted: DataFrame, min_seconds: float = 1800.0, labels: LabelMap = LabelMap()) -> DataFrame:
    """The budget of each calendar hour that is covered enough, and one row more wherever hours are missing between two of them."""
    rows = time_budget(voted, [F.date_trunc("hour", "dt_local").alias("hour")], labels)
    rows = rows.withColumn("seconds_total", F.sum("chunks").over(Window.partitionBy("hour")) * F.lit(CHUNK_SECONDS)).filter(F.col("seconds_total") >= F.lit(min_seconds))
    gaps = _gaps(rows.select("hour").distinct())
    marked = rows.withColumn("is_gap", F.lit(False)).unionByName(gaps, allowMissingColumns=True)
    return marked.withColumn("label", F.when(F.col("is_gap"), F.col("gap")).otherwise(hour_label(F.col("hour")))).withColumn("period", F.when(~F.col("is_gap"), F.when(is_night(F.hour("hour")), "night").otherwise("day")))


def sound_diet(events: DataFrame) -> DataFrame:
    """Share of event seconds by macro category."""
    per = events.groupBy("macro").agg(F.sum("duration_s").alias("secs"), F.count("*").alias("events"))
    return per.select("macro", round_to(F.col("secs")).alias("event_seconds"), "events", round_to(F.lit(100.0) * F.col("secs") / F.sum("secs").over(Window.partitionBy())).alias("pct"))


def period_levels(chunks: DataFrame) -> DataFrame:
    """One row: the three period levels and their day-evening-night level."""
    h = F.hour("dt_local")
    of = lambda hours: leq(F.when(h.isin(*hours), F.col("dba")))
    row = chunks.agg(of(LDEN_DAY).alias("lday_db"), of(LDEN_EVENING).alias("levening_db"), of(LDEN_NIGHT).alias("lnight_db"))
    return row.withColumn("lden_db", lden(F.col("lday_db"), F.col("levening_db"), F.col("lnight_db")))


def recording_summary(chunks: DataFrame) -> DataFrame:
    """Chunks, bounds and seconds of each recording."""
    per = chunks.groupBy("source_file").agg(F.count("*").alias("chunks"), F.min("dt_utc").alias("a"), F.max("dt_utc").alias("b"))
    span = (F.unix_micros("b") - F.unix_micros("a")) / F.lit(1e6)
    seconds = F.when(span > 0, span + F.lit(CHUNK_SECONDS)).otherwise(F.col("chunks") * F.lit(CHUNK_SECONDS))
    return per.select("source_file", "chunks", F.date_format("a", "yyyy-MM-dd HH:mm:ss").alias("first_utc"), F.date_format("b", "yyyy-MM-dd HH:mm:ss").alias("last_utc"), round_to(seconds, 3).alias("seconds"))


def total_seconds(chunks: DataFrame) -> DataFrame:
    """One row: recordings and their seconds together."""
    return recording_summary(chunks).agg(F.count("*").alias("recordings"), round_to(F.sum("seconds")).alias("seconds"))


def categories(voted: DataFrame, labels: LabelMap = LabelMap()) -> DataFrame:
    """The categories that occur, in chart order."""
    found = voted.select("category").distinct()
    return found.select("category", F.row_number().over(Window.orderBy(category_rank(F.col("category"), labels), "category")).alias("place"))


def location(chunks: DataFrame, site: str | None = None) -> DataFrame:
    """One row: the site's label, else the device with most chunks, of equals the first seen."""
    per = chunks.groupBy("device_id").agg(F.count("*").alias("c"), F.min(F.struct("dt_utc", "chunk_id")).alias("f"))
    top = per.agg(F.max("c").alias("m")).join(per, F.col("c") == F.col("m")).agg(F.min_by("device_id", "f").alias("device"))
    return top.select(F.coalesce(F.lit(site), "device", F.lit("Unknown site")).alias("location"))


__all__ = ["categories", "category_rank", "hourly_budget", "level_percentiles", "location", "period_levels", "recording_summary", "sound_diet", "stats", "time_budget", "timeline", "total_seconds", "typical_day", "with_gaps"]
