"""Comfort, indoor estimates and guideline checks as rules over one row of levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.acoustics import clamp, indoor, is_night, leq, percentile, round_to

# Penalty caps, references and rates; grades by least score; guideline levels.
CAPS = {"night": 40.0, "day": 35.0, "volatility": 25.0}
GRADES = ((85, "A", "Tranquil"), (70, "B", "Balanced"), (55, "C", "Active"), (40, "D", "Vibrant"), (None, "E", "Intense"))
CLOSED_DB, OPEN_DB = 30.0, 15.0
WHO_NIGHT, WHO_DAY = 45.0, 53.0


def comfort(chunks: DataFrame) -> DataFrame:
    """One row: penalties, score and grade; missing parts give their share to the others."""
    night = is_night(F.hour("dt_local"))
    row = chunks.agg(
        leq(F.when(night, F.col("dba"))).alias("l_night_db"),
        round_to(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY dba) FILTER (WHERE NOT hour(dt_local) IN (22,23,0,1,2,3,4,5,6))")).alias("l50_day_db"),
        round_to(F.lit(100.0) * F.count_if(~F.col("gated")) / F.count("*")).alias("noisy_pct"),
        F.count("*").alias("n"),
    ).filter("n > 0")
    raw = {"night": (F.col("l_night_db") - 40.0) * 2.0, "day": (F.col("l50_day_db") - 45.0) * 1.5, "volatility": F.col("noisy_pct") - 10.0}
    raw = {k: F.when(v.isNotNull(), clamp(v, 0.0, CAPS[k])) for k, v in raw.items()}
    caps = sum((F.when(raw[k].isNotNull(), F.lit(c)).otherwise(0.0) for k, c in CAPS.items()), F.lit(0.0))
    row = row.withColumn("_scale", F.when(caps > 0, F.lit(100.0) / caps).otherwise(1.0))
    row = row.withColumns({f"{k}_penalty": F.coalesce(round_to(v * F.col("_scale"), 2), F.lit(0.0)) for k, v in raw.items()})
    score = F.bround(clamp(F.lit(100.0) - F.col("night_penalty") - F.col("day_penalty") - F.col("volatility_penalty"), 0.0, 100.0)).cast("int")
    row = row.withColumn("score", score)
    grade, label = F.lit(GRADES[-1][1]), F.lit(GRADES[-1][2])
    for least, g, name in reversed(GRADES[:-1]):
        grade, label = F.when(F.col("score") >= least, g).otherwise(grade), F.when(F.col("score") >= least, name).otherwise(label)
    has_day, has_night = F.col("l50_day_db").isNotNull(), F.col("l_night_db").isNotNull()
    cover = F.when(has_day & has_night, "full").when(has_day, "day only").when(has_night, "night only").otherwise("none")
    return row.withColumn("grade", grade).withColumn("label", label).withColumn("coverage", cover).withColumn("insufficient", ~(has_day & has_night)).drop("_scale", "n")


def badges(levels: DataFrame, peak: Column | None = None) -> DataFrame:
    """``levels(lday_db, lnight_db, lden_db)`` with indoor estimates and the tones of sleep, office and nap badges."""
    row = levels.withColumns({
        "night_closed": indoor(F.col("lnight_db"), CLOSED_DB), "night_open": indoor(F.col("lnight_db"), OPEN_DB),
        "lden_closed": indoor(F.col("lden_db"), CLOSED_DB), "lden_open": indoor(F.col("lden_db"), OPEN_DB),
        "day_closed": indoor(F.col("lday_db"), CLOSED_DB), "day_open": indoor(F.col("lday_db"), OPEN_DB),
    })
    c, o = F.col("night_closed"), F.col("night_open")
    sleep = F.when(c.isNull(), "watch").when((c <= 30) & (o <= 40), "ok").when((c <= 30) & (o <= 45), "watch").when(c <= 40, "watch").otherwise("alert")
    c, o = F.col("lden_closed"), F.col("lden_open")
    office = F.when(c.isNull(), "watch").when((c <= 35) & (o <= 45), "ok").when(c <= 50, "watch").otherwise("alert")
    c, o = F.coalesce("night_closed", "day_closed"), F.when(F.col("night_closed").isNotNull(), F.col("night_open")).otherwise(F.col("day_open"))
    spike = F.lit(False) if peak is None else F.coalesce(peak >= 70.0, F.lit(False))
    baby = F.when(c.isNull(), "watch").when(spike | ((o > 40) & ~(c <= 30)), "alert").when(o > 40, "watch").otherwise("ok")
    return row.withColumn("sleep_badge", sleep).withColumn("office_badge", office).withColumn("baby_badge", baby)


def who_check(levels: DataFrame) -> DataFrame:
    """``levels(lnight_db, lden_db)`` against the outdoor guideline."""
    night, day = F.col("lnight_db"), F.col("lden_db")
    met = [night <= WHO_NIGHT, day <= WHO_DAY]
    known = [night.isNotNull(), day.isNotNull()]
    every = F.coalesce(met[0], F.lit(True)) & F.coalesce(met[1], F.lit(True))
    some = F.coalesce(met[0], F.lit(False)) | F.coalesce(met[1], F.lit(False))
    tone = F.when(~(known[0] | known[1]), "watch").when(every, "ok").when(some, "watch").otherwise("alert")
    return levels.select("lnight_db", "lden_db", met[0].alias("night_met"), met[1].alias("day_met"), round_to(night - WHO_NIGHT).alias("night_delta"), round_to(day - WHO_DAY).alias("day_delta"), tone.alias("tone"))


def experience(chunks: DataFrame) -> DataFrame:
    """One row: period levels, the highest peak, badges, whether data are too few for a judgment, and the warning."""
    from . import profiles

    peak = chunks.agg(F.max(F.coalesce("lafmax", "dba")).alias("peak_db"))  # one row
    row = badges(profiles.period_levels(chunks).crossJoin(peak), F.col("peak_db"))
    night, day = F.col("lnight_db").isNotNull(), F.col("lday_db").isNotNull() | F.col("levening_db").isNotNull()
    warning = F.when(~night, "no night").when(~day, "no day")
    return row.withColumn("insufficient", ~(night & day)).withColumn("warning", warning)


def resource_level(pct: Column, warn: float, critical: float) -> Column:
    """ok, warn or critical."""
    return F.when(pct.isNull(), "unknown").when(pct >= critical, "critical").when(pct >= warn, "warn").otherwise("ok")


# Warning and critical bounds of a host's resources.
CPU, MEMORY, TEMPERATURE, PING = (70.0, 90.0), (75.0, 90.0), (70.0, 80.0), (80.0, 200.0)
WIFI, DISK_GIB, DISK_PCT = (-60.0, -70.0), (4.0, 1.0), (20.0, 10.0)


def wifi_level(dbm: Column) -> Column:
    return F.when(dbm.isNull(), "unknown").when(dbm < WIFI[1], "critical").when(dbm < WIFI[0], "warn").otherwise("ok")


def wifi_pct(dbm: Column) -> Column:
    """Signal strength of -90 to -30 dBm as 0 to 100."""
    return round_to(clamp((dbm + F.lit(90.0)) / F.lit(60.0) * F.lit(100.0), 0.0, 100.0))


def ping_level(ms: Column, ok: Column) -> Column:
    return F.when(~F.coalesce(ok, F.lit(False)) | ms.isNull(), "critical").otherwise(resource_level(ms, *PING))


def disk_level(free: Column, total: Column) -> Column:
    """By free bytes and their share; a disk of no size has none."""
    gib, pct = free / F.lit(float(1 << 30)), F.when(total > 0, F.lit(100.0) * free / total).otherwise(F.lit(0.0))
    return F.when((gib < DISK_GIB[1]) | (pct < DISK_PCT[1]), "critical").when((gib < DISK_GIB[0]) | (pct < DISK_PCT[0]), "warn").otherwise("ok")


def overall_level(*levels: Column) -> Column:
    """The worst of several; unknown counts as ok."""
    has = lambda name: F.lit(False) if not levels else F.array_contains(F.array(*levels), name)
    return F.when(has("critical"), "critical").when(has("warn"), "warn").otherwise("ok")


# What the bits of a throttle mask mean, now from bit 0 on and since the start from bit 16 on.
THROTTLE = ("under_voltage", "freq_capped", "throttled", "soft_temp_limit")


def throttle_flags(mask: Column) -> Column:
    """Levels of a throttle bit mask: bits 0 to 3 tell of now, bits 16 to 19 of before."""
    return F.when(mask.bitwiseAND(F.lit(0xF)) > 0, "critical").when(mask.bitwiseAND(F.lit(0xF0000)) > 0, "warn").otherwise("ok")


def throttle_names(mask: Column, since_start: bool = False) -> Column:
    """Which conditions a mask tells of, now or since the start."""
    shift = 16 if since_start else 0
    names = [F.when(mask.bitwiseAND(F.lit(1 << (k + shift))) > 0, F.lit(n)) for k, n in enumerate(THROTTLE)]
    return F.array_compact(F.array(*names))


__all__ = ["badges", "comfort", "disk_level", "experience", "overall_level", "percentile", "ping_level", "resource_level", "throttle_flags", "throttle_names", "who_check", "wifi_level", "wifi_pct"]
