"""The loudest moments and what surrounds them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.labels import SILENCE, UNCLASSIFIED


def spaced_peaks(chunks: DataFrame, limit: int = 3, apart_s: int = 60) -> DataFrame:
    """The loudest chunks of which any two are ``apart_s`` seconds apart or more; of equals the earliest.

    ``chunks`` has votes and categories (``votes.with_votes``); a gated moment is
    called silence, one without a vote unclassified.  Each of the ``limit`` steps
    is one top-1 over a pruned scan; only its row comes to the driver.
    """
    label = F.when(F.col("gated"), F.lit(SILENCE)).otherwise(F.coalesce("vote", F.lit(UNCLASSIFIED)))
    at = F.date_format("dt_local", "yyyy-MM-dd HH:mm:ss")
    left = chunks.withColumn("level", F.coalesce("lafmax", "dba"))
    taken: list = []
    for rank in range(1, max(1, limit) + 1):
        top = left.orderBy(F.col("level").desc(), "dt_utc", "chunk_id").limit(1).select("chunk_id", F.unix_micros("dt_utc").alias("us"), "level", "dba", "source_file", "category", label.alias("label"), at.alias("at_local")).first()
        if top is None:
            break
        taken.append((rank, *top))
        left = left.filter(F.abs(F.unix_micros("dt_utc") - F.lit(top["us"])) >= apart_s * 1_000_000)
    return chunks.sparkSession.createDataFrame(taken, "rank int, chunk_id long, us long, level double, dba double, source_file string, category string, label string, at_local string")


def snippets(chunks: DataFrame, peaks: DataFrame, around_s: int = 45) -> DataFrame:
    """Chunks of a peak's recording within ``around_s`` seconds of it, both ends included, and which is nearest.

    The peaks are as few as their limit, so they are broadcast.
    """
    p = F.broadcast(peaks.select("rank", F.col("us").alias("peak_us"), "source_file"))
    us = F.unix_micros("dt_utc")
    near = chunks.join(p, "source_file").filter(us.between(F.col("peak_us") - around_s * 1_000_000, F.col("peak_us") + around_s * 1_000_000))
    rows = near.select("rank", "chunk_id", ((us - F.col("peak_us")) / F.lit(1e6)).alias("offset_s"), "dba")
    best = rows.groupBy("rank").agg(F.min_by("chunk_id", F.struct(F.abs("offset_s"), "chunk_id")).alias("nearest_id"))
    return rows.join(F.broadcast(best), "rank").select("rank", "chunk_id", "offset_s", "dba", (F.col("chunk_id") == F.col("nearest_id")).alias("nearest"))
