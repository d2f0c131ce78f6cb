"""The three-zone report over a selection of recordings, and its briefing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.acoustics import is_night, leq, level_percentiles
from ..functions.text import level_anchor
from ..operators import peaks, profiles, scoring, segment, votes
from ..sources.events import chunks as table_chunks
from ..sources.labels import SILENCE, LabelMap


def _rows(df: DataFrame) -> list[dict[str, Any]]:
    """Rows of a result whose size is fixed (hours of a day, categories, a top-k) or one for each covered hour."""
    return [r.asDict(recursive=True) for r in df.collect()]


def build(chunks: DataFrame, labels: LabelMap = LabelMap(), site: str | None = None, covered_s: float = 1800.0, l90_offset: float | None = None) -> dict[str, Any]:
    """Zones A (levels), B (profiles) and C (composition) and the briefing; the chunks are read once and cached."""
    chunks = chunks.cache()
    try:
        threshold = None if l90_offset is None else segment.l90_threshold(chunks, l90_offset, labels.threshold)
        voted = votes.with_votes(chunks, labels)
        events = segment.acoustic_events(chunks, labels, threshold)
        top = peaks.spaced_peaks(voted)
        levels = _rows(chunks.agg(leq(F.col("dba")).alias("leq_db"), *level_percentiles(), F.count("*").alias("chunks")))[0]
        anchor = chunks.sparkSession.createDataFrame([(levels["l50_db"] if levels["l50_db"] is not None else levels["leq_db"],)], "v double").select(level_anchor(F.col("v"))).first()[0]
        periods = profiles.period_levels(chunks)
        zone_a = levels | {
            "leq_context": anchor, "location": profiles.location(chunks, site).first()[0], "total": _rows(profiles.total_seconds(chunks))[0], "top_disturbances": _with_snippets(top, chunks),
            "comfort_rating": next(iter(_rows(scoring.comfort(chunks))), None), "lived_experience": _rows(scoring.experience(chunks))[0], "guideline": _rows(scoring.who_check(periods))[0],
        }
        zone_b = {"typical_day": _rows(profiles.typical_day(chunks).orderBy("hour")), "timeline": _rows(profiles.with_gaps(profiles.timeline(chunks, covered_s)).orderBy("hour"))}
        period = F.when(is_night(F.hour("dt_local")), "night").otherwise("day").alias("period")
        zone_c = {
            "sound_diet": _rows(profiles.sound_diet(events)), "categories": [r["category"] for r in _rows(profiles.categories(voted, labels).orderBy("place"))],
            "time_budget": _rows(profiles.time_budget(voted, [], labels).orderBy("place")), "time_budget_period": _rows(profiles.time_budget(voted, [period], labels).orderBy("period", "place")),
            "time_budget_hourly": _rows(profiles.hourly_budget(voted, covered_s, labels).orderBy("hour", "place")),
            "events": _rows(events.orderBy(F.col("duration_s").desc(), F.col("max_dba").desc(), "start_rn").limit(12)),
        }
        return {"zone_a": zone_a, "zone_b": zone_b, "zone_c": zone_c, "takeaway": takeaway(zone_a, zone_b, zone_c)}
    finally:
        chunks.unpersist()


def _with_snippets(top: DataFrame, chunks: DataFrame) -> list[dict[str, Any]]:
    """The loudest moments, each with the levels around it and the place of its own among them."""
    around: dict[int, list[dict[str, Any]]] = {}
    for r in _rows(peaks.snippets(chunks, top).orderBy("rank", "offset_s", "chunk_id")):  # a minute and a half for each
        around.setdefault(r["rank"], []).append(r)
    out = []
    for r in _rows(top.drop("us").orderBy("rank")):
        rows = around.get(r["rank"], [])
        out.append(r | {"snippet": {"dba": [x["dba"] for x in rows], "peak_index": next((k for k, x in enumerate(rows) if x["nearest"]), 0)}})
    return out


def stream(load: Callable[[], DataFrame], **options: Any) -> Iterator[dict[str, Any]]:
    """Progress and then the report, or what went wrong; too little memory is told apart."""
    yield {"stage": "start"}
    try:
        yield {"stage": "loading"}
        rows = load()
        yield {"stage": "loaded", "chunks": rows.count()}
        yield {"stage": "aggregating"}
        yield {"stage": "done", "report": build(rows, **options)}
    except Exception as e:  # noqa: BLE001 - the caller gets the error as a line
        short = isinstance(e, MemoryError) or "OutOfMemoryError" in str(e)
        yield {"stage": "error", "code": "oom" if short else "failed", "message": str(e)[:500]}


def day_band(hours: list[dict[str, Any]], within: float = 3.0) -> tuple[int, int] | None:
    """First and last hour around the loudest daytime hour that stay within 3 dB of it."""
    level = {h["hour"]: h["leq_db"] for h in hours if h["period"] == "day" and h["leq_db"] is not None}
    if not level:
        return None
    a = b = max(level, key=lambda h: (level[h], -h))
    least = level[a] - within
    while level.get(a - 1, least - 1) >= least:
        a -= 1
    while level.get(b + 1, least - 1) >= least:
        b += 1
    return a, b


def takeaway(zone_a: dict[str, Any], zone_b: dict[str, Any], zone_c: dict[str, Any]) -> str:
    """A short briefing in our own words, a paragraph each on character, rhythm, effect, the loudest moment and what is missing; the same rows give the same text."""
    comfort, paragraphs = zone_a.get("comfort_rating") or {}, []
    l50, l90, l10 = (zone_a.get(k) for k in ("l50_db", "l90_db", "l10_db"))
    out = []
    if comfort.get("grade"):
        out.append(f"Comfort grade {comfort['grade']} ({comfort['label'].lower()}), score {comfort['score']}.")
    if l50 is not None:
        context = zone_a.get("leq_context")
        out.append(f"Typical level {l50:.1f} dBA" + (f", comparable to: {context.lower()}." if context and context != "—" else "."))
    if l90 is not None and l10 is not None:
        out.append(f"It stays near {l90:.1f} dBA when quiet and gets to {l10:.1f} dBA when loud.")
    paragraphs.append(out)
    out = []
    if band := day_band(zone_b["typical_day"]):
        out.append(f"Daytime is loudest from {band[0]:02d}:00 to {band[1] + 1:02d}:00.")
    shares = sorted(((-r["pct"], r["category"]) for r in zone_c["time_budget"] if r["category"] != SILENCE and r["pct"] > 0))
    if shares:
        text = f"Most of the sound is {shares[0][1]} ({-shares[0][0]:.0f} %)"
        out.append(text + (f", then {shares[1][1]} ({-shares[1][0]:.0f} %)." if len(shares) > 1 and -shares[1][0] >= 8 else "."))
    silence = sum(r["pct"] for r in zone_c["time_budget"] if r["category"] == SILENCE)
    if silence >= 20:
        out.append(f"{silence:.0f} % of the time is relative silence.")
    paragraphs.append(out)
    out = []
    if l50 is not None:
        out.append("By day it is " + ("loud." if l50 >= 70 else "busy." if l50 >= 55 else "moderate." if l50 >= 40 else "quiet."))
    nights = [h["leq_db"] for h in zone_b["typical_day"] if h["period"] == "night" and h["leq_db"] is not None]
    if nights:
        floor = min(nights)
        out.append(f"The quietest night hour has {floor:.0f} dBA: " + ("sleep needs closed windows." if floor >= 55 else "noticeable with open windows." if floor >= 45 else "restful."))
    paragraphs.append(out)
    top = next(iter(zone_a.get("top_disturbances") or []), None)
    if top:
        paragraphs.append([f"Loudest moment: {top['level']:.1f} dBA, {top['category'] or top['label']}, {top['at_local']}."])
    if comfort.get("insufficient"):
        paragraphs.append([f"Data cover {comfort['coverage']}; the grade rests on that part."])
    return "\n\n".join(" ".join(p) for p in paragraphs if p)


def report_briefing(spark: SparkSession, d: str) -> DataFrame:
    """The briefing of the whole table, one row."""
    made = build(table_chunks(spark, d), covered_s=5.0)
    return spark.createDataFrame([(made["takeaway"], made["zone_a"]["leq_db"], len(made["zone_c"]["events"]))], "takeaway string, leq_db double, top_events int")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"report_briefing": report_briefing}
