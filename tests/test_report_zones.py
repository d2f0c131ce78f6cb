"""The report's zones hold the timeline and the budgets by period and hour."""

import datetime as dt

from earshot.operators import profiles
from earshot.plans import report
from test_levels import T0, chunks


def test_timeline_and_budgets(spark):
    late = T0 + dt.timedelta(hours=10)  # 23:00 local
    rows = chunks(spark, [60, 61, 62] * 4).union(chunks(spark, [50, 51] * 4, start=late))
    made = report.build(rows, covered_s=5.0)
    line = made["zone_b"]["timeline"]
    assert [(r["hour"].hour, r["is_gap"], r["chunks"]) for r in line] == [(13, False, 12), (14, True, None), (23, False, 8)]
    assert report.build(rows, covered_s=10.0)["zone_b"]["timeline"] == line[:1]
    period, hourly = made["zone_c"]["time_budget_period"], made["zone_c"]["time_budget_hourly"]
    assert sorted((r["period"], r["chunks"], r["pct"]) for r in period) == [("day", 12, 100.0), ("night", 8, 100.0)]
    assert [(r["hour"].hour, r["category"], r["chunks"], r["is_gap"], r["gap_hours"]) for r in hourly] == [(13, "Human & Community", 12, False, None), (14, None, None, True, 9), (23, "Human & Community", 8, False, None)]
    assert [r["hour"].hour for r in report.build(rows, covered_s=10.0)["zone_c"]["time_budget_hourly"]] == [13]
    assert made["zone_c"]["categories"] == ["Human & Community"] and made["zone_a"]["total"]["recordings"] == 1
    assert made["zone_a"]["lived_experience"]["warning"] is None and made["zone_a"]["comfort_rating"]["insufficient"] is False
    assert [x["stage"] for x in report.stream(lambda: rows, covered_s=5.0)] == ["start", "loading", "loaded", "aggregating", "done"]
    assert list(report.stream(lambda: 1 / 0))[-1]["code"] == "failed"


def test_loudest_moments_and_the_briefing(spark):
    """Spaced peaks with label, category and what surrounds them; a paragraph each on levels, the loudest moment and missing nights."""
    levels = [50.0] * 30 + [90.0] + [50.0] * 119 + [80.0] + [50.0] * 20
    rows = chunks(spark, levels, gated=[k == 150 for k in range(len(levels))])
    made = report.build(rows, covered_s=5.0)
    top = made["zone_a"]["top_disturbances"]
    assert [(t["level"], t["label"], t["category"], t["at_local"]) for t in top[:2]] == [(93.0, "Speech", "Human & Community", "2026-01-15 13:00:30"), (83.0, "Relative silence", "Relative silence", "2026-01-15 13:02:30")]
    assert len(top[0]["snippet"]["dba"]) == 76 and top[0]["snippet"]["peak_index"] == 30 and top[0]["snippet"]["dba"][30] == 90.0
    text = made["takeaway"].split("\n\n")
    assert "stays near 50.0 dBA when quiet and gets to 50.0 dBA" in text[0] and "Loudest moment: 93.0 dBA, Human & Community, 2026-01-15 13:00:30." in text
    assert text[-1] == "Data cover day only; the grade rests on that part."
    assert report.build(rows, covered_s=5.0)["takeaway"] == made["takeaway"]


def test_categories_in_chart_order(spark):
    names = ["Relative silence", "Zebra", "Unclassified / Ambient", "Apes", "Human & Community", "Traffic & Transit"]
    rows = profiles.categories(spark.createDataFrame([(n,) for n in names], "category string")).orderBy("place").collect()
    assert [r["category"] for r in rows] == ["Traffic & Transit", "Human & Community", "Unclassified / Ambient", "Apes", "Zebra", "Relative silence"]
