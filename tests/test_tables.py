"""Tables that grow: levels by day, recordings by folder, the last minutes of a stream."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from test_levels import T0, chunks

from earshot.operators import histograms, profiles, votes
from earshot.sources import recordings
from earshot.streaming import watch


def rows_of(df):
    return sorted(map(str, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))


@pytest.fixture(scope="module")
def voted(spark):
    rng = random.Random(4)
    levels = [round(rng.uniform(30, 90), 1) for _ in range(1200)]
    c = chunks(spark, levels, step=300.0, gated=[rng.random() < 0.2 for _ in levels])
    c = c.withColumn("device_id", F.when(F.col("chunk_id") % 3 == 0, "a").otherwise("b")).withColumn("top_label", F.when(F.col("chunk_id") % 4 == 0, "Vehicle").otherwise("Bird"))
    return votes.with_votes(c).cache()


def test_profiles_from_cells_equal_those_from_chunks(voted):
    cells = histograms.cells(voted)
    assert rows_of(histograms.timeline(cells, 5.0)) == rows_of(profiles.timeline(voted, 5.0))
    assert rows_of(histograms.typical_day(cells)) == rows_of(profiles.typical_day(voted))
    assert rows_of(histograms.period_levels(cells)) == rows_of(profiles.period_levels(voted))
    assert rows_of(histograms.time_budget(cells, [])) == rows_of(profiles.time_budget(voted, []))
    assert rows_of(histograms.time_budget(cells, [F.col("hour")])) == rows_of(profiles.time_budget(voted, [F.date_trunc("hour", "dt_local").alias("hour")]))
    assert cells.count() <= voted.count() and histograms.cells(voted.limit(0)).count() == 0
    assert histograms.period_levels(cells.limit(0)).first()["lden_db"] is None


def test_a_new_day_reads_and_writes_that_day_only(spark, voted, tmp_path):
    at = str(tmp_path / "cells")
    days = [r[0] for r in voted.select(F.to_date("dt_local").alias("day")).distinct().orderBy("day").collect()]
    histograms.append(voted.filter(F.to_date("dt_local") < days[-1]), at)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "cells").glob("day=*/*.parquet")}
    histograms.append(voted.filter(F.to_date("dt_local") == days[-1]), at)
    histograms.append(voted.filter(F.to_date("dt_local") == days[-1]), at)  # again: the day is replaced, not doubled
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())
    whole = histograms.read(spark, at)
    assert rows_of(histograms.typical_day(whole)) == rows_of(profiles.typical_day(voted))
    one = whole.filter(F.col("day") == F.lit(days[-1]))
    assert {p.split("/day=")[1][:10] for p in one.inputFiles()} >= {str(days[-1])}
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def event_rows(spark, names):
    rows = [(n, i, T0 + dt.timedelta(seconds=i), 50.0 + i) for n in names for i in range(5)]
    return spark.createDataFrame(rows, "source_file string, chunk_index int, dt_utc timestamp, dba double")


def test_deleting_recordings_leaves_the_others_alone(spark, tmp_path):
    at, names = tmp_path / "table", [f"r {k}:%é=.jsonl" for k in range(70)]
    recordings.append(event_rows(spark, names), str(at))
    files = {p: p.stat().st_mtime_ns for p in at.glob("*/*.parquet")}
    assert len(files) == 70
    got = recordings.delete(spark, str(at), [*names[:62], "none.jsonl", names[69]], writing=[names[69]])
    assert got == {"deleted": names[:62], "writing": [names[69]], "missing": ["none.jsonl"]}
    left = {p: p.stat().st_mtime_ns for p in at.glob("*/*.parquet")}
    assert len(left) == 8 and all(files[p] == t for p, t in left.items())
    assert {r[0] for r in recordings.read(spark, str(at)).select("recording").distinct().collect()} == set(names[62:])
    recordings.replace(event_rows(spark, names[62:63]).filter("chunk_index < 2"), str(at))
    assert recordings.read(spark, str(at), names[62:63]).count() == 2 and recordings.read(spark, str(at)).count() == 2 + 7 * 5
    for bad in ([], [str(k) for k in range(65)]):
        with pytest.raises(ValueError):
            recordings.delete(spark, str(at), bad)
    late = recordings.read(spark, str(at)).withColumn("dt_utc", F.when(F.col("recording") == names[65], F.col("dt_utc") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("dt_utc")))
    assert recordings.being_written(late, 60, "2026-01-15 13:00:30") == {names[65]}


def test_lines_of_progress_and_the_last_minutes(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    at = str(tmp_path / "in")
    rows = [("pi", r, i, "gated" if i % 5 == 0 else "Speech", f"2026-01-15T12:{i // 60:02d}:{i % 60:02d}.000Z", T0 + dt.timedelta(seconds=i + 7200 * (r == "b"))) for r in "ab" for i in range(150)]
    schema = "device_id string, recording_id string, chunk_index int, top_label string, created_at string, dt_utc timestamp"
    for part in (rows[:110], rows[110:260], rows[260:]):
        spark.createDataFrame(part, schema).repartition(1).write.mode("append").parquet(at)
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(at)
    listener = watch.Totals()
    spark.streams.addListener(listener)
    q = watch.progress(watch.observed(read())).writeStream.format("memory").queryName("lines").option("checkpointLocation", str(tmp_path / "ck1")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["recording_id"], r["events"], r["gated"]) for r in spark.table("lines").collect())
    assert got == [("a", 60, 12), ("a", 120, 24), ("b", 60, 12), ("b", 120, 24)]
    table = str(tmp_path / "rolling")
    watch.roll(read(), table, str(tmp_path / "ck2")).awaitTermination()
    near = watch.last_seconds(spark, table, 60)
    assert sorted(r["chunk_index"] for r in near.collect()) == list(range(89, 150))
    assert len(list((tmp_path / "rolling").glob("slot=*"))) == 3  # the first recording's slots are gone
    for _ in range(100):
        if listener.totals:
            break
        __import__("time").sleep(0.1)
    spark.streams.removeListener(listener)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(v[0] for v in listener.totals.values()) == 300 and sum(v[1] for v in listener.totals.values()) == 60
