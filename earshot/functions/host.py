"""What a host's tools print, and tolerant casts, as column expressions."""

from __future__ import annotations

import os
import socket

from pyspark.sql import Column
from pyspark.sql import functions as F

from .acoustics import round_to


def _found(text: Column, pattern: str) -> Column:
    """The first group of the first match, null where there is none."""
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 1), F.lit(""))


def wifi_name(text: Column) -> Column:
    """The network's name in a listing of a wireless link."""
    return F.nullif(F.trim(_found(text, r"(?m)^[ \t]*SSID:[ \t]*(.+?)[ \t]*$")), F.lit(""))


def wifi_signal(text: Column) -> Column:
    """The signal in dBm in such a listing, one decimal."""
    return round_to(_found(text, r"(?i)signal:\s*(-?\d+(?:\.\d+)?)\s*dBm").cast("double"))


def ping_ms(text: Column) -> Column:
    """The round trip in milliseconds that a ping prints, one decimal."""
    return round_to(_found(text, r"(?i)time[=<](\d+(?:\.\d+)?)\s*ms").cast("double"))


def default_interface(text: Column) -> Column:
    """The device of a default route."""
    return _found(text, r"\bdev\s+(\S+)")


def lists_capture_cards(text: Column) -> Column:
    """Whether a listing of capture hardware names a card."""
    return F.coalesce(text, F.lit("")).rlike(r"(?m)^card \d+:")


def number(text: Column, default: float | None = None) -> Column:
    """Text as a number; the default where it isn't one."""
    return F.coalesce(F.trim(text).try_cast("double"), F.lit(default).cast("double"))


def count(text: Column, default: int | None = None) -> Column:
    """Text as a whole number, not negative; the default where it isn't one."""
    return F.greatest(F.coalesce(F.trim(text).try_cast("long"), F.lit(default).cast("long")), F.when(F.lit(default is not None) | F.trim(text).try_cast("long").isNotNull(), F.lit(0).cast("long")))


def device_id(variable: str = "DEVICE_ID") -> str:
    """The device's name: a variable of the environment, else the host's name."""
    return os.environ.get(variable, "").strip() or socket.gethostname()
