"""Levels, profiles, scores and formats against known values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from earshot.functions import acoustics, text
from earshot.operators import overview, peaks, profiles, scoring, votes
from earshot.plans import report

T0 = dt.datetime(2026, 1, 15, 12, 0, 0)
SCHEMA = "chunk_id long, dt_utc timestamp, device_id string, dba double, lafmax double, top_label string, top_confidence double, gated boolean, source_file string, clap_status string"


def chunks(spark, levels, step=1.0, start=T0, label="Speech", gated=None):
    rows = [(i, start + dt.timedelta(seconds=i * step), "pi", float(v), v + 3.0, label, 0.9, bool(gated and gated[i]), "a.jsonl", None) for i, v in enumerate(levels)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("dt_local", F.from_utc_timestamp("dt_utc", "Europe/Amsterdam"))


def test_equal_levels(spark):
    assert chunks(spark, [50, 50]).agg(acoustics.leq(F.col("dba"))).first()[0] == 50.0


def test_percentiles(spark):
    row = chunks(spark, range(40, 50)).agg(*acoustics.level_percentiles()).first()
    assert (row["l90_db"], row["l50_db"], row["l10_db"]) == (40.0, 44.0, 48.0)


@pytest.mark.parametrize("day,evening,night,want", [(None, None, 45.0, 55.0), (50.0, None, 40.0, 50.0), (None, None, None, None), (60.0, 55.0, 50.0, 60.0)])
def test_lden(spark, day, evening, night, want):
    row = spark.createDataFrame([(day, evening, night)], "d double, e double, n double").select(acoustics.lden(F.col("d"), F.col("e"), F.col("n"))).first()
    assert row[0] == want


def test_local_hours(spark):
    day = {r["hour"]: r for r in profiles.typical_day(chunks(spark, [50.0])).collect()}
    assert len(day) == 24 and day[13]["leq_db"] == 50.0 and day[12]["leq_db"] is None


def test_gap_rows(spark):
    rows = chunks(spark, [50.0]).union(chunks(spark, [51.0], start=T0 + dt.timedelta(hours=5)))
    out = profiles.with_gaps(profiles.timeline(rows, 0.5)).orderBy("hour").collect()
    assert [r["is_gap"] for r in out] == [False, True, False] and out[1]["gap_hours"] == 4 and out[1]["gap"] == "4 h gap"
    assert profiles.timeline(rows).count() == 0  # covered too little


def test_autumn_hour_merges(spark):
    at = dt.datetime(2026, 10, 25, 0, 30)
    rows = chunks(spark, [50.0, 60.0], step=3600, start=at)
    assert profiles.timeline(rows, 0.5).count() == 1


def test_spaced_peaks(spark):
    rows = [(i, T0 + dt.timedelta(seconds=s), "pi", v, v + 3.0, "x", 0.9, False, "a", None) for i, (s, v) in enumerate([(0, 90.0), (1, 89.0), (120, 80.0), (240, 70.0), (300, 50.0)])]
    c = spark.createDataFrame(rows, SCHEMA).withColumn("dt_local", F.col("dt_utc"))
    top = peaks.spaced_peaks(votes.with_votes(c))
    assert [r["level"] for r in top.orderBy("rank").collect()] == [93.0, 83.0, 73.0]
    near = peaks.snippets(c, top).filter("rank = 1").collect()
    assert sorted(r["chunk_id"] for r in near) == [0, 1] and [r["chunk_id"] for r in near if r["nearest"]] == [0]


@pytest.mark.parametrize("score,grade", [(85, "A"), (84, "B"), (70, "B"), (55, "C"), (40, "D"), (39, "E")])
def test_grades(score, grade):
    assert next(g for least, g, _ in scoring.GRADES if least is None or score >= least) == grade


def test_comfort_parts(spark):
    night = chunks(spark, [48.0] * 10, start=dt.datetime(2026, 1, 15, 1))
    day = chunks(spark, [54.0] * 10)
    row = scoring.comfort(night.union(day)).first()
    assert (row["night_penalty"], row["day_penalty"], row["volatility_penalty"], row["coverage"]) == (16.0, 13.5, 25.0, "full")
    assert scoring.comfort(day).first()["coverage"] == "day only"
    assert scoring.comfort(day.limit(0)).count() == 0


def test_guideline(spark):
    levels = spark.createDataFrame([(44.0, 60.0), (None, None), (50.0, 60.0), (40.0, 50.0)], "lnight_db double, lden_db double")
    assert [r["tone"] for r in scoring.who_check(levels).collect()] == ["watch", "watch", "alert", "ok"]


def test_loud_rows(spark):
    c = chunks(spark, [50, 60, 70, 55]).withColumn("lafmax", F.col("dba") + 5).withColumn("lafmax", F.when(F.col("dba") == 55, 58.0).otherwise(F.col("lafmax")))
    row = overview.summary(c).first()
    assert (row["loud_chunks"], row["loud_pct"], row["l50_db"]) == (2, 50.0, 55.0)


def test_diet_goes_by_seconds(spark):
    events = spark.createDataFrame([("Human & Community", 1.0), ("Traffic & Transit", 30.0)], "macro string, duration_s double")
    assert {r["macro"]: r["pct"] for r in profiles.sound_diet(events).collect()}["Traffic & Transit"] == 96.8


def test_formats(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert [get(text.gap_label(F.lit(h))) for h in (4, 24, 50)] == ["4 h gap", "1 d gap", "2 d 2 h gap"]
    assert [get(text.duration_label(F.lit(s))) for s in (30, 60, 3660, 90000)] == ["< 1 min", "1 min", "1 h 1 min", "1 d 1 h 0 min"]
    assert [get(text.human_bytes(F.lit(float(n)))) for n in (10, 2048, 5 << 20)] == ["10 B", "2.0 KB", "5.0 MB"]
    assert get(text.safe_name(F.lit("a b/ü-_!"))) == "abü-_" and get(text.safe_name(F.lit("!!"))) == "recording"
    assert get(text.export_name(F.lit("x.jsonl"), False, False)) == "x-no-spectrum-no-preprocess.jsonl"
    d = lambda s: F.to_date(F.lit(s))
    assert get(text.header_span(d("2026-01-02"), d("2026-01-05"))) == "Jan 2 – 5"
    assert get(text.header_span(d("2025-12-30"), d("2026-01-05"))) == "Dec 30, 2025 – Jan 05, 2026"


def test_report(spark):
    made = report.build(chunks(spark, [60, 61, 40, 62, 40, 40, 40, 70, 71] * 20))
    assert made["zone_a"]["location"] == "pi" and len(made["zone_b"]["typical_day"]) == 24 and made["zone_c"]["events"]
    assert made["takeaway"].startswith("Comfort grade")
    assert [x["stage"] for x in report.stream(lambda: chunks(spark, [60, 61]))] == ["start", "loading", "loaded", "aggregating", "done"]
