"""Acoustic level arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One chunk lasts this long; hours of the day by local clock.
CHUNK_SECONDS = 0.975
NIGHT_HOURS = (22, 23, 0, 1, 2, 3, 4, 5, 6)
LDEN_DAY = tuple(range(7, 19))
LDEN_EVENING = tuple(range(19, 23))
LDEN_NIGHT = (23, 0, 1, 2, 3, 4, 5, 6)
DEFAULT_ZONE = "Europe/Amsterdam"


def round_to(c: Column, digits: int = 1) -> Column:
    """Half up on the binary value: the same operations as in any other engine."""
    scale = F.lit(float(10**digits))
    return F.floor(c * scale + F.lit(0.5)) / scale


def energy(level: Column) -> Column:
    return F.pow(F.lit(10.0), level / F.lit(10.0))


def decibels(power: Column) -> Column:
    return F.lit(10.0) * F.log10(power)


def leq(level: Column) -> Column:
    """Energetic mean, one decimal."""
    return round_to(decibels(F.avg(energy(level))))


def percentile(level: Column, percent: int) -> Column:
    """Nearest rank, one decimal; L10 is percent 90 and L90 is percent 10."""
    return round_to(F.expr(f"percentile_disc({percent / 100}) WITHIN GROUP (ORDER BY {level._jc.toString()})"))


def level_percentiles(name: str = "dba") -> list[Column]:
    return [percentile(F.col(name), 90).alias("l10_db"), percentile(F.col(name), 50).alias("l50_db"), percentile(F.col(name), 10).alias("l90_db")]


def lden(day: Column, evening: Column, night: Column) -> Column:
    """Day-evening-night level of three period levels; missing periods give their hours to the others."""
    terms = [(12.0, day, 0.0), (4.0, evening, 5.0), (8.0, night, 10.0)]
    power = sum((F.coalesce(F.lit(h) * energy(level + F.lit(extra)), F.lit(0.0)) for h, level, extra in terms), F.lit(0.0))
    hours = sum((F.when(level.isNotNull(), F.lit(h)).otherwise(F.lit(0.0)) for h, level, _ in terms), F.lit(0.0))
    return F.when(hours > 0, round_to(decibels(power / hours)))


def indoor(outside: Column, attenuation: float) -> Column:
    """Estimate behind a facade, 20 dB at least."""
    return F.when(outside.isNotNull(), round_to(F.greatest(F.lit(20.0), outside - F.lit(attenuation))))


def is_night(hour: Column) -> Column:
    return hour.isin(*NIGHT_HOURS)


def dbfs(linear: Column) -> Column:
    return F.lit(20.0) * F.log10(F.greatest(linear, F.lit(1e-12)))


def from_dbfs(level: Column) -> Column:
    return F.pow(F.lit(10.0), level / F.lit(20.0))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def mel(hz: Column) -> Column:
    return F.lit(2595.0) * F.log10(F.lit(1.0) + hz / F.lit(700.0))


def octave_edges(centre: Column) -> tuple[Column, Column]:
    """Bounds of a third-octave band."""
    step = F.lit(2.0 ** (1 / 6))
    return centre / step, centre * step
