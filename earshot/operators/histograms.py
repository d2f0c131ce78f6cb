"""Levels as counts on the 0.1 dB grid: a table that grows by days and that every profile reads.

A cell counts the chunks of an hour, a device, a recording, a category and a
tenth of a dB.  Counts add up over any hours and devices, so percentiles, energy
averages, budgets and profiles of any selection come from cells, of which a day
has at most some thousands for each device, whatever its number of chunks.
Stored levels have one decimal, so nothing is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.acoustics import CHUNK_SECONDS, LDEN_DAY, LDEN_EVENING, LDEN_NIGHT, decibels, energy, is_night, lden, round_to
from ..sources.labels import LabelMap
from .profiles import category_rank

KEYS = ["day", "hour", "device_id", "source_file", "category", "gated", "tenth"]


def cells(voted: DataFrame) -> DataFrame:
    """Cells of chunks with categories: the columns of KEYS (day and hour by the local clock), chunks and the highest peak. Rows without a level have tenth null."""
    tenth = F.round(F.col("dba") * 10).cast("int")
    rows = voted.select(F.to_date("dt_local").alias("day"), F.date_trunc("hour", "dt_local").alias("hour"), "device_id", "source_file", "category", "gated", tenth.alias("tenth"), F.coalesce("lafmax", "dba").alias("peak"))
    return rows.groupBy(*KEYS).agg(F.count("*").alias("chunks"), F.max("peak").alias("max_peak"))


def append(voted: DataFrame, path: str) -> None:
    """Write the cells of the days that ``voted`` has; a day that is there already is replaced as a whole, other days stay untouched."""
    cells(voted).repartition("day").write.partitionBy("day").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The stored cells; a filter on day reads the files of these days only."""
    return spark.read.parquet(path)


def _level() -> Column:
    return F.col("tenth") / F.lit(10.0)


def leq_of(where: Column | None = None) -> Column:
    """Energetic mean of cells, one decimal; ``where`` leaves cells out."""
    n = F.when(F.col("tenth").isNotNull() if where is None else F.col("tenth").isNotNull() & where, F.col("chunks"))
    return round_to(decibels(F.sum(n * energy(_level())) / F.sum(n)))


def percentiles(some: DataFrame, keys: list[str], percents: dict[str, int]) -> DataFrame:
    """By ``keys``, nearest-rank percentiles under the names of ``percents``, from running counts over at most some thousand tenths a group."""
    per = some.filter("tenth IS NOT NULL").groupBy(*keys, "tenth").agg(F.sum("chunks").alias("n"))
    group = Window.partitionBy(*keys)
    per = per.select(*keys, "tenth", F.sum("n").over(group.orderBy("tenth")).alias("upto"), F.sum("n").over(group).alias("all"))
    out = [round_to(F.min(F.when(F.col("upto") * 100 >= F.col("all") * p, _level()))).alias(name) for name, p in percents.items()]
    return per.groupBy(*keys).agg(*out)


def stats(some: DataFrame, keys: list[str]) -> DataFrame:
    """By ``keys``: leq_db, l90_db, l10_db, chunks, gated_chunks and gated_pct, as chunks give them."""
    gated = F.sum(F.when(F.col("gated"), F.col("chunks")).otherwise(0))
    sums = some.groupBy(*keys).agg(leq_of().alias("leq_db"), F.sum("chunks").alias("chunks"), gated.alias("gated_chunks"), round_to(F.lit(100.0) * gated / F.sum("chunks")).alias("gated_pct"))
    return sums.join(percentiles(some, keys, {"l90_db": 10, "l10_db": 90}), keys, "left").select(*keys, "leq_db", "l90_db", "l10_db", "chunks", "gated_chunks", "gated_pct")


def device_levels(some: DataFrame) -> DataFrame:
    """By device: leq_db, chunks and the percentiles L10, L50 and L90."""
    sums = some.groupBy("device_id").agg(leq_of().alias("leq_db"), F.sum("chunks").alias("chunks"))
    return sums.join(percentiles(some, ["device_id"], {"l10_db": 90, "l50_db": 50, "l90_db": 10}), "device_id", "left")


def timeline(some: DataFrame, min_seconds: float = 1800.0) -> DataFrame:
    """Levels by local hour, without hours that are covered too little."""
    hours = stats(some, ["hour"]).filter(F.col("chunks") * F.lit(CHUNK_SECONDS) >= F.lit(min_seconds))
    return hours.withColumn("period", F.when(is_night(F.hour("hour")), "night").otherwise("day"))


def typical_day(some: DataFrame) -> DataFrame:
    """24 rows: levels by hour of the day, null where there are none."""
    by = stats(some.withColumn("hour", F.hour("hour")), ["hour"])
    every = some.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    out = every.join(by, "hour", "left").fillna(0, ["chunks", "gated_chunks"])
    return out.withColumn("period", F.when(is_night(F.col("hour")), "night").otherwise("day"))


def period_levels(some: DataFrame) -> DataFrame:
    """One row: the three period levels and their day-evening-night level."""
    h = F.hour("hour")
    row = some.agg(*[leq_of(h.isin(*hours)).alias(name) for name, hours in (("lday_db", LDEN_DAY), ("levening_db", LDEN_EVENING), ("lnight_db", LDEN_NIGHT))])
    return row.withColumn("lden_db", lden(F.col("lday_db"), F.col("levening_db"), F.col("lnight_db")))


def time_budget(some: DataFrame, keys: list, labels: LabelMap = LabelMap()) -> DataFrame:
    """Seconds and share of each category within groups of ``keys``, and its place among those that the group has."""
    per = some.groupBy(*keys, "category").agg(F.sum("chunks").alias("chunks"))
    keyed = [c for c in per.columns if c not in ("category", "chunks")]
    whole = Window.partitionBy(*keyed)
    place = F.row_number().over(whole.orderBy(category_rank(F.col("category"), labels), "category"))
    return per.select(*keyed, "category", place.alias("place"), "chunks", (F.col("chunks") * F.lit(CHUNK_SECONDS)).alias("seconds"), round_to(F.lit(100.0) * F.col("chunks") / F.sum("chunks").over(whole)).alias("pct"))
