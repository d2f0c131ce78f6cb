"""Acoustic events, label spans and chart samples: operators over row order.

Global order without a partition key would put all rows into one task.  Rows
are therefore ordered within hours, one small row for each hour carries counts
and the last active row forward, and each hour starts from what it is handed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.acoustics import CHUNK_SECONDS, decibels, energy, round_to
from ..sources.labels import THEME_RULES, UNCLASSIFIED, LabelMap
from .votes import macro_of, with_themes, with_votes


def by_slice(rows: DataFrame, sums: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with what ``sums`` has for their keys and _slice; null keys match."""
    names = [*keys, "_slice"]
    named = sums.select(*[F.col(c).alias(f"_on{i}") for i, c in enumerate(names)], *[c for c in sums.columns if c not in names])
    return rows.join(named, [F.col(c).eqNullSafe(F.col(f"_on{i}")) for i, c in enumerate(names)]).drop(*[f"_on{i}" for i in range(len(names))])


def numbered(rows: DataFrame, keys: list[str] | None = None, order: tuple[str, ...] = ("dt_utc", "chunk_id")) -> DataFrame:
    """``rows`` with ``rn`` (from 1, over all rows or by ``keys``) and ``n`` (their number); rows without a time come first."""
    keys = keys or []
    day = rows.withColumn("_slice", F.date_trunc("hour", "dt_utc"))
    local = Window.partitionBy(*keys, "_slice").orderBy(*order)
    sizes = day.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    over = Window.partitionBy(*keys).orderBy("_slice") if keys else Window.orderBy("_slice")
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy()
    sizes = sizes.select(*keys, "_slice", (F.sum("_n").over(over) - F.col("_n")).alias("_before"), F.sum("_n").over(whole).alias("n"))
    joined = by_slice(day.withColumn("_rn", F.row_number().over(local)), sizes, keys)
    return joined.withColumn("rn", F.col("_rn") + F.col("_before")).drop("_rn", "_before")


def members(chunks: DataFrame, threshold: Column, labels: LabelMap) -> DataFrame:
    """Chunks that belong to an event, with its number ``event``.

    An event may have all rows, so nothing is grouped by it here: where the last
    active row of all lies tells which quiet rows at the end belong to none.
    """
    gap = labels.max_gap
    rows = numbered(chunks).withColumn("active", F.col("dba") >= threshold)
    on = F.when(F.col("active"), F.col("rn"))
    local = Window.partitionBy("_slice").orderBy("rn")
    rows = rows.withColumn("_prev", F.last(on, True).over(local.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_last", F.last(on, True).over(local))
    days = rows.groupBy("_slice").agg(F.max(on).alias("_on"))
    carried = days.select("_slice", F.max("_on").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"), F.max("_on").over(Window.partitionBy()).alias("_end"))
    rows = rows.join(carried, "_slice")
    rows = rows.withColumn("_prev", F.coalesce("_prev", "_carry")).withColumn("_last", F.coalesce("_last", "_carry"))
    start = F.col("active") & (F.col("_prev").isNull() | (F.col("rn") - F.col("_prev") - 1 > gap))
    rows = rows.withColumn("_start", start.cast("int")).withColumn("_local", F.sum("_start").over(local))
    starts = rows.groupBy("_slice").agg(F.sum("_start").alias("_s"))
    starts = starts.select("_slice", (F.sum("_s").over(Window.orderBy("_slice")) - F.col("_s")).alias("_ahead"))
    rows = rows.join(starts, "_slice").withColumn("event", F.col("_local") + F.col("_ahead"))
    # Quiet rows up to the gap end an event; where the rows themselves end first, they end no event.
    cut = (F.col("n") - F.col("_end") <= gap) & (F.col("rn") > F.col("_end"))
    rows = rows.filter((F.col("event") > 0) & (F.col("rn") - F.col("_last") <= gap) & ~cut)
    return rows.drop("_prev", "_last", "_carry", "_start", "_local", "_ahead", "_end", "_slice")


def acoustic_events(chunks: DataFrame, labels: LabelMap = LabelMap(), threshold: DataFrame | None = None, rules=THEME_RULES) -> DataFrame:
    """One row for each event: bounds, duration, levels, the label that most chunks vote for, and its macro.

    ``threshold`` is a table of one row, as ``l90_threshold`` gives; without it the label map's counts.
    """
    voted = with_votes(chunks, labels, rules)
    if threshold is None:
        voted = voted.withColumn("_threshold", F.lit(labels.threshold))
    else:
        voted = voted.crossJoin(F.broadcast(threshold.select(F.col("threshold").alias("_threshold"))))  # one row
    rows = members(voted, F.col("_threshold"), labels)
    # By event and vote first, then by event: one pass over the rows gives levels and votes.
    parts = rows.groupBy("event", "vote").agg(
        F.min("dt_utc").alias("start"), F.max("dt_utc").alias("end"), F.count("*").alias("c"), F.min("rn").alias("f"),
        F.max("dba").alias("max_dba"), F.max("lafmax").alias("max_lafmax"), F.sum(energy(F.col("dba"))).alias("energy"), F.count("dba").alias("levels"),
    )
    out = parts.groupBy("event").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("c").alias("chunk_count"), F.min("f").alias("start_rn"), F.max("max_dba").alias("max_dba"), F.max("max_lafmax").alias("max_lafmax"),
        round_to(decibels(F.sum("energy") / F.sum("levels"))).alias("leq_db"), F.max_by("vote", F.when(F.col("vote").isNotNull(), F.struct("c", -F.col("f")))).alias("dominant"),
    ).filter(F.col("chunk_count") >= labels.min_chunks)
    hiss = F.coalesce(F.col("dominant").isin(*labels.hiss), F.lit(False)) & (F.col("max_dba") > labels.hiss_above)
    out = out.withColumn("resolved", F.when(hiss, F.lit(labels.hiss_target)).otherwise(F.coalesce("dominant", F.lit(UNCLASSIFIED))))
    out = with_themes(out, "resolved", rules).withColumn("macro", macro_of(F.col("resolved"), F.col("theme"), labels))
    span = (F.unix_micros("end") - F.unix_micros("start")) / F.lit(1e6)
    duration = F.when(span > 0, span + F.lit(CHUNK_SECONDS)).otherwise(F.col("chunk_count") * F.lit(CHUNK_SECONDS))
    return out.select("start_rn", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start_utc"), F.date_format("end", "yyyy-MM-dd HH:mm:ss").alias("end_utc"), round_to(duration, 2).alias("duration_s"), "chunk_count", "max_dba", "max_lafmax", "leq_db", "dominant", "resolved", "macro")


def l90_threshold(chunks: DataFrame, offset: float = 5.0, default: float = LabelMap().threshold) -> DataFrame:
    """One row: the selection's quiet floor plus an offset, two decimals; the default where there is no level."""
    from ..functions.acoustics import percentile

    floor = chunks.agg(percentile(F.col("dba"), 10).alias("l90_db"))
    return floor.select("l90_db", round_to(F.coalesce(F.col("l90_db") + F.lit(offset), F.lit(float(default))), 2).alias("threshold"))


def label_spans(chunks: DataFrame, min_confidence: float = 0.25, keys: tuple[str, ...] = ("device_id",)) -> DataFrame:
    """Runs of consecutive rows with one label; gated, unlabelled and unsure rows end a run.

    Rows are compared within hours; the last label of the hour before, and how many
    runs began before, come from one small row for each key and hour.
    """
    keys_, order = list(keys), F.struct("dt_utc", "chunk_id")
    good = ~F.col("gated") & F.col("top_label").isNotNull() & F.col("dba").isNotNull() & (F.col("top_confidence").isNull() | (F.col("top_confidence") >= min_confidence))
    rows = chunks.withColumn("_l", F.when(good, F.col("top_label"))).withColumn("_slice", F.date_trunc("hour", "dt_utc"))
    local, over = Window.partitionBy(*keys_, "_slice").orderBy("dt_utc", "chunk_id"), Window.partitionBy(*keys_).orderBy("_slice")
    ends = rows.groupBy(*keys_, "_slice").agg(F.max_by(F.struct("_l"), order).alias("_end"))
    rows = by_slice(rows, ends.select(*keys_, "_slice", F.lag("_end").over(over).alias("_carry")), keys_)
    before = F.when(F.row_number().over(local) == 1, F.col("_carry._l")).otherwise(F.lag("_l").over(local))
    rows = rows.withColumn("_new", (~F.col("_l").eqNullSafe(before)).cast("int")).withColumn("_local", F.sum("_new").over(local))
    starts = rows.groupBy(*keys_, "_slice").agg(F.sum("_new").alias("_s"))
    rows = by_slice(rows, starts.select(*keys_, "_slice", (F.sum("_s").over(over) - F.col("_s")).alias("_ahead")), keys_)
    rows = rows.withColumn("span", F.col("_local") + F.col("_ahead")).filter("_l IS NOT NULL")
    return rows.groupBy(*keys_, "span").agg(F.first("_l").alias("label"), F.min("dt_utc").alias("t0"), F.max("dt_utc").alias("t1"), F.min_by("dba", order).alias("height"), F.min("top_confidence").alias("confidence"), F.count("*").alias("rows"))


def change_markers(spans: DataFrame) -> DataFrame:
    """Where each span starts."""
    return spans.select("device_id", "label", F.col("t0").alias("t"), F.col("height").alias("dba"), "confidence")


def downsample(chunks: DataFrame, most: int = 1500) -> DataFrame:
    """At most ``most`` rows in order: of each stretch of rows the loudest, then the highest peak, then the first."""
    rows = numbered(chunks)
    stretch = F.expr(f"((rn - 1 + 1) * {most} - 1) div n")
    pick = F.max_by(F.struct(*rows.columns), F.struct("dba", "lafmax", -F.col("rn")))
    few = rows.filter(F.col("n") <= most) if most >= 2 else rows
    many = rows.filter(F.col("n") > most).groupBy(stretch.alias("_b")).agg(pick.alias("_r")).select("_r.*") if most >= 2 else rows.limit(0)
    return few.unionByName(many).drop("_slice")


def inspect_marks(chunks: DataFrame, centre: str, seconds: int = 120, min_confidence: float = 0.0) -> DataFrame:
    """Label spans of the rows of a window alone: a span that reaches beyond it is cut."""
    return label_spans(inspect_window(chunks, centre, seconds), min_confidence)


def inspect_window(chunks: DataFrame, centre: str, seconds: int = 120) -> DataFrame:
    """Full resolution around a time, both ends included; the width is held to 30 to 900 seconds."""
    w = min(max(seconds, 30), 900)
    at = F.unix_micros(F.to_timestamp(F.lit(centre)))
    return chunks.filter(F.unix_micros("dt_utc").between(at - w * 500_000, at + w * 500_000))
