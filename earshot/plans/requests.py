"""Checked parameters of reports, overviews and windows."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from typing import Any
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from ..functions.acoustics import DEFAULT_ZONE
from ..sources.labels import LabelMap

#: Most recordings of one report, and of one deletion.
MOST_FILES, MOST_DELETED = 32, 64


def clamp(value: Any, low: float, high: float, default: float) -> float:
    """A number within bounds; the default where it isn't one."""
    try:
        x = float(value)
    except (TypeError, ValueError):
        return default
    return min(max(x, low), high) if x == x else default


def safe_file(name: str) -> bool:
    """A plain ``.jsonl`` file name, without a path."""
    return bool(re.fullmatch(r"[^/\\\0]+\.jsonl", name)) and not name.startswith(".")


def zone(name: str | None) -> tuple[str, str | None]:
    """A known time zone, and a warning where another had to be taken."""
    try:
        ZoneInfo(name or DEFAULT_ZONE)
    except (ZoneInfoNotFoundError, ValueError):
        return DEFAULT_ZONE, f"unknown time zone {name!r}; using {DEFAULT_ZONE}"
    return name or DEFAULT_ZONE, None


@dataclass(frozen=True)
class ReportRequest:
    """A report's files, label map, and offset from the quiet floor (None: the absolute threshold)."""

    files: tuple[str, ...]
    labels: LabelMap
    l90_offset: float | None


def report_request(body: dict[str, Any], labels: LabelMap = LabelMap()) -> ReportRequest:
    """A report request from a JSON body; files are named once each, counts are not negative."""
    files = tuple(dict.fromkeys(str(f) for f in body.get("files") or ()))
    if not 1 <= len(files) <= MOST_FILES or not all(map(safe_file, files)):
        raise ValueError(f"name 1 to {MOST_FILES} .jsonl files")
    changed = replace(
        labels, min_confidence=clamp(body.get("min_confidence"), 0.0, 1.0, labels.min_confidence), threshold=clamp(body.get("threshold_db"), -1e6, 1e6, labels.threshold),
        min_chunks=int(clamp(body.get("min_event_chunks"), 0, 1e9, labels.min_chunks)), max_gap=int(clamp(body.get("max_gap_chunks"), 0, 1e9, labels.max_gap)),
    )
    offset = clamp(body.get("l90_offset_db"), -1e6, 1e6, 5.0) if body.get("threshold_mode") == "l90_offset" else None
    return ReportRequest(files, changed, offset)


def delete_request(names: list[str], active: str | None = None) -> tuple[str, ...]:
    """Recordings to delete: named once each, 64 at most, and not the one that is being written."""
    out = tuple(dict.fromkeys(names))
    if not 1 <= len(out) <= MOST_DELETED or not all(map(safe_file, out)):
        raise ValueError(f"name 1 to {MOST_DELETED} .jsonl files")
    if active in out:
        raise ValueError("a recording in progress can't be deleted")
    return out
