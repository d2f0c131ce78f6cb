"""Labels and formats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gap_label(hours: Column) -> Column:
    """``N h gap``, ``D d gap`` or ``D d R h gap``."""
    days, rest = F.floor(hours / 24), F.pmod(hours, F.lit(24))
    return F.when(hours < 24, F.concat(hours.cast("string"), F.lit(" h gap"))).when(rest == 0, F.concat(days.cast("string"), F.lit(" d gap"))).otherwise(F.concat(days.cast("string"), F.lit(" d "), rest.cast("string"), F.lit(" h gap")))


def duration_label(seconds: Column) -> Column:
    """``X d Y h Z min`` without leading parts that are zero; ``< 1 min`` below that, ``0 min`` for none."""
    whole = F.bround(seconds).cast("long")
    days, hours, minutes = F.floor(whole / 86400), F.floor(F.pmod(whole, F.lit(86400)) / 3600), F.floor(F.pmod(whole, F.lit(3600)) / 60)
    day = F.when(days > 0, F.concat(days.cast("string"), F.lit(" d")))
    hour = F.when((days > 0) | (hours > 0), F.concat(hours.cast("string"), F.lit(" h")))
    joined = F.concat_ws(" ", day, hour, F.concat(minutes.cast("string"), F.lit(" min")))
    return F.when(whole < 0, F.lit(None).cast("string")).when(whole == 0, "0 min").when(whole < 60, "< 1 min").otherwise(joined)


def timeout_label(hours: Column, minutes: Column) -> Column:
    """A duration as ``Nh`` or ``Nm``; an hour where nothing is left of it."""
    part = lambda c, k: F.greatest(F.coalesce(c.try_cast("double"), F.lit(0.0)), F.lit(0.0)) * F.lit(float(k))
    total = F.bround(part(hours, 60) + part(minutes, 1)).cast("long")
    total = F.when(total <= 0, F.lit(60)).otherwise(total)
    return F.when(total % 60 == 0, F.concat((total / 60).cast("long").cast("string"), F.lit("h"))).otherwise(F.concat(total.cast("string"), F.lit("m")))


def hour_label(hour: Column) -> Column:
    """``15 Jan 13:00``."""
    return F.date_format(hour, "dd MMM HH:mm")


def day_label(hour: Column) -> Column:
    """``15 Jan``."""
    return F.date_format(hour, "dd MMM")


def level_label(level: Column, digits: int = 0) -> Column:
    """``54 dBA``; null where there is no level."""
    return F.when(level.isNotNull(), F.format_string(f"%.{digits}f dBA", level.cast("double")))


def utc_iso(at: Column) -> Column:
    """A time in UTC to the millisecond, with Z, in a session whose zone is UTC."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def recording_name(at: Column) -> Column:
    """The id of a recording that starts at a time, in a session whose zone is UTC."""
    return F.date_format(at, "yyyy-MM-dd'T'HH-mm-ss'Z'")


def human_bytes(n: Column) -> Column:
    """Sizes in units of 1024, one decimal."""
    out = F.format_string("%.1f TB", n / F.lit(float(1 << 40)))
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB")):
        out = F.when(n < F.lit(float(1 << (10 * (power + 1)))), F.format_string(f"%.1f {unit}", n / F.lit(float(1 << (10 * power))))).otherwise(out)
    return F.when(n < 1024, F.format_string("%d B", n.cast("long"))).otherwise(out)


def recording_period(hour_utc: Column) -> Column:
    """The part of the day that prefixes a recording's name."""
    return F.when(hour_utc.between(5, 11), "morning").when(hour_utc.between(12, 17), "day").when(hour_utc.between(18, 22), "evening").otherwise("night")


def safe_name(name: Column) -> Column:
    """Letters, digits, hyphen and underscore; ``recording`` where nothing is left."""
    kept = F.regexp_replace(F.coalesce(name, F.lit("")), r"[^\p{L}\p{N}_-]", "")
    return F.when(kept == "", F.lit("recording")).otherwise(kept)


def header_span(first: Column, last: Column) -> Column:
    """A date span in one, two or two full dates, as the years and months differ."""
    same_year, same_month = F.year(first) == F.year(last), F.month(first) == F.month(last)
    long_ = lambda d: F.date_format(d, "MMM dd, yyyy")
    return (
        F.when(first == last, F.date_format(first, "yyyy-MM-dd"))
        .when(same_year & same_month, F.concat(F.date_format(first, "MMM d"), F.lit(" – "), F.date_format(last, "d")))
        .when(same_year, F.concat(F.date_format(first, "MMM d"), F.lit(" – "), F.date_format(last, "MMM d")))
        .otherwise(F.concat(long_(first), F.lit(" – "), long_(last)))
    )


def level_anchor(level: Column) -> Column:
    """What a typical level is like."""
    return F.when(level.isNull(), "—").when(level < 40, "Quiet bedroom").when(level < 55, "Conversational backdrop").when(level < 70, "Busy street / TV").otherwise("Lawnmower / peak traffic")


def export_name(name: Column, spectrum: bool, gate: bool) -> Column:
    """File name of an export that leaves fields out."""
    tags = ("" if spectrum else "-no-spectrum") + ("" if gate else "-no-preprocess")
    return F.regexp_replace(name, r"^(.*?)(\.[^.]*)?$", f"$1{tags}$2") if tags else name
