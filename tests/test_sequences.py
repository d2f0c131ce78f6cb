"""Operators over row order against small sequential models; streaming against batch."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F
from test_levels import SCHEMA, T0, chunks

from earshot.operators import capture, embed, gate, segment, votes
from earshot.sources.labels import LabelMap, TriggerConfig
from earshot.streaming import live


def model(levels, threshold=45.0, gap=2, least=2):
    """Events as (first row, rows), one row after the other."""
    out, current, quiet = [], [], 0
    for i, v in enumerate(levels):
        if v >= threshold:
            quiet = 0
            current.append(i)
        elif current:
            quiet += 1
            if quiet <= gap:
                current.append(i)
            else:
                out.append(current)
                current, quiet = [], 0
    while current and levels[current[-1]] < threshold:
        current.pop()
    out.append(current)
    return [(e[0] + 1, len(e)) for e in out if len(e) >= least]


def test_events_equal_the_model(spark):
    rng = random.Random(1)
    for gap, least in ((0, 1), (2, 2), (3, 1)):
        levels = [rng.choice([40.0, 60.0]) if rng.random() < 0.7 else 40.0 for _ in range(250)]
        c = chunks(spark, levels, step=3600.0)  # over many days
        got = segment.acoustic_events(c, LabelMap(max_gap=gap, min_chunks=least))
        assert sorted((r["start_rn"], r["chunk_count"]) for r in got.collect()) == model(levels, gap=gap, least=least)


def test_one_endless_event(spark):
    """Rows that never fall silent are one event, and no window is grouped by it."""
    c = chunks(spark, [60.0] * 300, step=60.0)
    out = segment.acoustic_events(c)
    assert [(r["start_rn"], r["chunk_count"]) for r in out.collect()] == [(1, 300)]
    plan = segment.members(votes.with_votes(c), F.lit(45.0), LabelMap())._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Window" in line and "[event" in line]


def test_golden_events(spark):
    count = lambda levels: segment.acoustic_events(chunks(spark, levels)).collect()
    assert len(count([60, 58, 40, 59, 57])) == 1 and len(count([60, 58, 40, 40, 40, 59, 57])) == 2
    hiss = segment.acoustic_events(chunks(spark, [55, 56, 60, 58], label="Wind")).first()
    assert (hiss["resolved"], hiss["macro"]) == ("Vehicle / Tire Rolling", "Traffic & Transit")
    assert count([40, 40]) == []


def test_spans_break(spark):
    c = chunks(spark, [50] * 6, gated=[0, 0, 1, 0, 0, 0])
    assert sorted(r["rows"] for r in segment.label_spans(c).collect()) == [2, 3]


def test_spans_and_numbers_over_hours(spark):
    """Spans that reach over hours, many devices, null among them: the same as one pass over each device."""
    rng = random.Random(7)
    n = 400
    c = chunks(spark, [50.0] * n, step=500.0, gated=[rng.random() < 0.1 for _ in range(n)]).withColumn("top_label", F.element_at(F.array(*map(F.lit, "aaaab")), (F.pmod(F.hash("chunk_id"), F.lit(5)) + 1).cast("int")))
    c = c.withColumn("device_id", F.when(F.col("chunk_id") % 7 > 2, F.lit("x")).when(F.col("chunk_id") % 7 > 0, F.lit("y")))
    want, last = {}, {}
    for r in c.orderBy("chunk_id").collect():
        label = None if r["gated"] else r["top_label"]
        if label is not None:
            if last.get(r["device_id"]) != label:
                want.setdefault(r["device_id"], []).append([label, 0, r["dt_utc"]])
            want[r["device_id"]][-1][1] += 1
        last[r["device_id"]] = label
    got = {}
    for r in segment.label_spans(c).orderBy("t0").collect():
        got.setdefault(r["device_id"], []).append([r["label"], r["rows"], r["t0"]])
    assert got == want and None in got
    places = {(r["device_id"], r["chunk_id"]): (r["rn"], r["n"]) for r in segment.numbered(c, ["device_id"]).collect()}
    assert len(places) == n
    for d in ("x", "y", None):
        ids = sorted(i for k, i in places if k == d)
        assert [places[d, i] for i in ids] == [(k + 1, len(ids)) for k in range(len(ids))]


def test_captures_of_recordings_are_apart(spark):
    """A cooldown of one recording doesn't keep another from arming."""
    c = chunks(spark, [70.0] * 40, step=0.975, label="Vehicle").withColumn("recording_id", F.when(F.col("chunk_id") < 3, "a").otherwise("b"))
    whole = {r["chunk_id"]: r["status"] for r in capture.captures(c.drop("recording_id"), TriggerConfig(cooldown_s=20.0)).collect()}
    apart = {r["chunk_id"]: r["status"] for r in capture.captures(c, TriggerConfig(cooldown_s=20.0)).collect()}
    assert whole[0] == apart[0] == apart[3] == "scheduled" and whole[3] == "pending" and len(apart) == 40


def test_downsample_keeps_the_loudest(spark):
    levels = [50.0 + (i * 7919) % 30 for i in range(100)]
    out = sorted(segment.downsample(chunks(spark, levels), 10).collect(), key=lambda r: r["rn"])
    want = [max(range(k * 10, k * 10 + 10), key=lambda i: (levels[i], -i)) + 1 for k in range(10)]
    assert [r["rn"] for r in out] == want
    assert segment.downsample(chunks(spark, levels), 200).count() == 100


def test_window_has_both_ends(spark):
    c = chunks(spark, [50] * 121)
    at = (T0 + dt.timedelta(seconds=60)).strftime("%Y-%m-%d %H:%M:%S")
    assert segment.inspect_window(c, at, 60).count() == 61


def gate_model(rows):
    """(open, reason, gain) row by row from (raw, level, peak)."""
    out, history, open_, streak, previous, amps = [], [], False, 0, None, []
    for raw, level, peak in rows:
        floor = round(float(np.percentile(history, 10)), 9) if history else raw
        most = min(max(-23.0 - floor - 18.0, 12.0), 40.0)
        warm, above, reason = level + most >= -35.0, level >= floor + 5.0, "closed"
        if open_:
            if above and warm:
                streak, reason = 0, "hold"
            else:
                streak += 1
                if streak >= 2:
                    open_, streak = False, 0
                else:
                    reason = "hold"
        elif above and warm:
            open_, reason, streak = True, "l90", 0
        if not open_ and warm and previous is not None and level - previous >= 4.0 and level >= -55.0:
            open_, reason, streak = True, "delta", 0
        gain = 0.0
        if open_:
            amps = [*amps, 10 ** (raw / 20)][-5:]
            gain = min(10 ** (-23 / 20) / (sum(amps) / len(amps)), 0.9 / peak, 10 ** (most / 20))
        out.append((open_, reason, round(gain, 9)))
        history, previous = [*history, raw][-300:], level
    return out


def test_gate_forms_agree(spark, tmp_path):
    rng = random.Random(2)
    levels = [rng.choice([70, 70.2, 70.4, 74.5, 80] if i < 350 else [50, 55, 60, 75]) + rng.random() / 4 for i in range(700)]
    rows = gate.levels(chunks(spark, levels)).withColumn("level", F.col("raw") + F.col("chunk_id") % 3 / 20).withColumn("peak", F.pow(F.lit(10.0), (F.col("level") + 8) / 20))
    given = [(r["raw"], r["level"], r["peak"]) for r in rows.orderBy("chunk_id").collect()]
    want = gate_model(given)
    assert {w[1] for w in want} == {"closed", "hold", "l90", "delta"}
    seen = lambda df: [(r["gate_open"], r["reason"], round(r["gain"], 9)) for r in df.orderBy("chunk_id").collect()]
    assert seen(gate.stage(rows)) == want
    values = rows.select("device_id", "dt_utc", "chunk_id", "raw", "level", "peak")
    assert seen(streamed(spark, tmp_path, values, lambda s: live.live_gate(s, "15 minutes"), "gates")) == want
    assert gate.stage(rows.limit(0)).count() == 0


def streamed(spark, tmp_path, rows, operator, name, files=7):
    """Rows dealt to micro-batches of a file each, far from their order in time, and one much later row of another device that ends them all."""
    at = str(tmp_path / name)
    late = rows.limit(1).withColumn("device_id", F.lit("later")).withColumn("dt_utc", F.lit(T0 + dt.timedelta(days=2)))
    rows.withColumn("_file", F.pmod(F.hash("chunk_id"), F.lit(files))).repartition(files, "_file").drop("_file").write.parquet(at)
    late.repartition(1).write.mode("append").parquet(at)
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(at)
    q = operator(source).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    kept = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert kept <= 4, kept  # of the later device alone: an ended recording leaves nothing
    return spark.table(name).filter("device_id <> 'later'")


def test_recordings_in_a_stream_are_apart(spark, tmp_path):
    """Two recordings of one device, interleaved and shuffled: each has a gate of its own, as in batch."""
    rng = random.Random(9)
    levels = [rng.choice([50, 55, 60, 75]) + rng.random() / 4 for _ in range(300)]
    rows = gate.levels(chunks(spark, levels)).withColumn("recording_id", F.when(F.col("chunk_id") % 3 == 0, "a").otherwise("b"))
    rows = rows.select("device_id", "recording_id", "dt_utc", "chunk_id", "raw", "level", "peak")
    key = lambda df: [(r["recording_id"], r["chunk_id"], r["gate_open"], r["reason"], round(r["floor"], 9), round(r["gain"], 9)) for r in df.orderBy("chunk_id").collect()]
    assert key(streamed(spark, tmp_path, rows, live.live_gate, "two")) == key(gate.stage(rows))


def test_one_device_in_many_stretches(spark):
    """Stretches of any length give the rows of one fold, by recording; one device takes many tasks."""
    rng = random.Random(12)
    levels = [rng.choice([70, 70.2, 74.5, 80] if i % 200 < 120 else [50, 55, 60, 75]) + rng.random() / 4 for i in range(1500)]
    rows = gate.levels(chunks(spark, levels)).withColumn("recording_id", F.when(F.col("chunk_id") < 1100, "a")).withColumn("peak", F.pow(F.lit(10.0), (F.col("level") + 8) / 20))
    given = [(r["raw"], r["level"], r["peak"]) for r in rows.orderBy("chunk_id").collect()]
    want = gate_model(given[:1100]) + gate_model(given[1100:])
    for stretch in (7, 299, 301, 4096):
        out = gate.stage(rows.repartition(6), stretch)
        got = out.orderBy("chunk_id").collect()
        assert [(r["gate_open"], r["reason"], round(r["gain"], 9)) for r in got] == want
        assert [r["ambient_count"] for r in got] == [min(k + 1, 300) for n in (1100, 400) for k in range(n)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would go to one task
    many = {i for (i,) in gate.stage(rows, 50).select(F.spark_partition_id()).collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(many) == 4


def test_maps_of_stretches_compose():
    rng = np.random.default_rng(6)
    raw = -60 + rng.choice([-10.0, 0, 4, 20], 700) + rng.random(700)
    level = raw + 3
    whole = gate.stretch_map(gate.GateState(), raw, level)
    state, maps, k = gate.GateState(), [], 0
    for n in (1, 300, 5, 394):
        maps.append(gate.stretch_map(state, raw[k : k + n], level[k : k + n]))
        k += n
        state = gate.GateState(raw[max(0, k - 300) : k].tolist(), float(level[k - 1]))
    left = gate.join_maps(gate.join_maps(gate.join_maps(maps[0], maps[1]), maps[2]), maps[3])
    right = gate.join_maps(maps[0], gate.join_maps(maps[1], gate.join_maps(maps[2], maps[3])))
    assert np.array_equal(left, whole) and np.array_equal(right, whole)
    walked = None
    for m in maps:
        walked = gate.after_map(walked, m)
    assert np.array_equal(walked, gate.after_map(None, whole))


def test_stage_from_batch_to_batch():
    """Rows in parts of any size, from state to state, give what one batch gives."""
    rng = np.random.default_rng(4)
    raw = -60 + rng.choice([-10.0, 0, 4, 20], 900) + rng.random(900)
    level, peak = raw + 3, 10 ** ((raw + 6) / 20)
    whole = gate.stage_rows(gate.GateState(), raw, level, peak)
    state, parts, k = gate.GateState(), [], 0
    for n in (1, 2, 299, 1, 301, 296):
        parts.append(gate.stage_rows(state, raw[k : k + n], level[k : k + n], peak[k : k + n]))
        k += n
    for name in whole:
        both = np.concatenate([np.asarray(p[name]) for p in parts])
        assert np.array_equal(both, np.asarray(whole[name])) if name == "reason" else np.allclose(both.astype(float), np.asarray(whole[name], float), equal_nan=True)


def test_stage_over_samples(spark):
    """A quiet hum, then a tone: the gate opens with it, and the gain keeps its peak below the limit."""
    t = np.arange(9600) / 48000
    rows = [("pi", T0 + dt.timedelta(seconds=i), i, ((0.2 if 20 <= i < 24 else 0.001) * np.sin(2 * np.pi * 1000 * t)).tolist()) for i in range(30)]
    pcm = spark.createDataFrame(rows, "device_id string, dt_utc timestamp, chunk_id long, pcm array<double>")
    measured = gate.from_samples(pcm)
    out = gate.stage(measured).orderBy("chunk_id").collect()
    assert [r["gate_open"] for r in out[20:24]] == [True] * 4 and not any(r["gate_open"] for r in out[:20])
    assert all(r["gain"] * r["peak"] <= 0.9 + 1e-9 for r in out if r["gate_open"])
    meta = gate.metadata(gate.stage(measured)).orderBy("chunk_id").collect()[20]["yamnet_preprocess"]
    assert meta["gate_open_reason"] == "l90" and not meta["gated"] and meta["ambient_sample_count"] == 21 and meta["gate_mode"] == "dynamic_l90"


def test_onset_and_lookback(spark):
    config = TriggerConfig()
    c = chunks(spark, [50.0] * 8)
    rows = c.withColumn("gate_open", F.col("chunk_id").isin(2, 3, 4, 7)).withColumn("raw", F.lit(-60.0)).withColumn("floor", F.when(F.col("chunk_id") >= 5, -70.0).otherwise(-60.0))
    got = {r["chunk_id"]: (r["reason"], r["rows_back"], round(r["lead_s"], 3)) for r in capture.onsets(rows, config).collect()}
    assert got[0] == ("trigger_chunk", 0, 0.975) and got[4] == ("gate_open", 2, 3.075)
    assert got[6] == ("energy_rise", 1, 2.1) and got[7] == ("gate_open", 0, 1.125)
    ring = capture.lookback(c, c.filter("chunk_id = 6")).orderBy("back").collect()
    assert [(r["chunk_id"], round(r["kept_s"], 3)) for r in ring] == [(6, 0.975), (5, 0.975), (4, 0.975), (3, 0.975), (2, 0.1)]
    fill = capture.fixed_fill(c, c.filter("chunk_id in (0, 7)")).orderBy("armed_id").collect()
    assert [(round(r["pad_before_s"], 3), round(r["pad_after_s"], 3), r["complete"]) for r in fill] == [(4.025, 0.0, True), (0.0, 5.0, False)]


def test_lead_of_a_capture_reaches_back():
    config = TriggerConfig(trigger=("Car",), max_event_s=10.0).normalised()
    state = capture.CaptureState()
    for i in range(4):
        capture.step(state, i * 0.975, "Hum", 60.0 + i, True, i, config)
    status, reason, done = capture.step(state, 3.9, "Car", 62.0, True, 4, config)
    assert (status, reason, done) == ("scheduled", "label:Car", None)
    assert state.seconds == 4.0 and state.peak == 63.0  # five open rows, of which the lookback holds four seconds
    early = TriggerConfig(trigger=("Car",), warm_rows=2).normalised()
    assert capture.step(capture.CaptureState(), 0.0, "Car", 60.0, True, 0, early)[:2] == ("skipped", "buffer_warming")


def test_cooldown_and_capture(spark, tmp_path):
    levels = [70.0] * 4 + [60.0] * 3 + [70.0] * 20
    c = chunks(spark, levels, step=0.975, label="Vehicle")
    out = sorted(capture.captures(c, TriggerConfig(cooldown_s=5.0)).collect(), key=lambda r: r["chunk_id"])
    assert out[0]["status"] == "scheduled" and out[1]["status"] == "pending"
    ends = [(r["capture_of"], r["end_reason"]) for r in out if r["end_reason"]]
    assert ends[0] == (0, "capped") or ends[0] == (0, "peak_decay")
    armed = [r["chunk_id"] for r in out if r["status"] == "scheduled"]
    assert all((b - a) * 0.975 >= 5.0 for a, b in zip(armed, armed[1:]))
    assert any(r["reason"] == "cooldown" for r in out) or len(armed) > 1
    values = c.select("device_id", "dt_utc", "chunk_id", "top_label", "dba", "gated")
    caps = streamed(spark, tmp_path, values, lambda s: live.live_captures(s, TriggerConfig(cooldown_s=5.0)), "caps").drop("recording_id")
    assert sorted(caps.collect(), key=lambda r: r["chunk_id"]) == out


def test_frame_spans(spark):
    f = spark.createDataFrame([("a", [0.1, 0.8, 0.9, 0.2, 0.0, 0.7, 0.6, 0.1])], "clip string, scores array<double>")
    out = sorted((r["t0_s"], r["t1_s"], r["confidence"]) for r in embed.frame_spans(f).collect())
    assert out == [(0.02, 0.06, 0.9), (0.1, 0.14, 0.7)]
    rows = f.select("clip", F.posexplode("scores").alias("place", "score")).repartition(3)
    assert sorted((r["t0_s"], r["t1_s"], r["confidence"]) for r in embed.frame_row_spans(rows).collect()) == out
    assert sorted(r["t0_s"] for r in embed.frame_row_spans(rows, min_span_s=0.06).collect()) == []


def test_windows_join_in_buckets(spark):
    rng = random.Random(3)
    rows = [(i, T0 + dt.timedelta(seconds=rng.uniform(0, 300)), "pi", 50.0, 53.0, "x", 0.9, False, "a", None) for i in range(200)]
    c = spark.createDataFrame(rows, SCHEMA)
    armed = c.filter("chunk_id % 10 = 0")
    got = {(r["armed_id"], r["chunk_id"]) for r in capture.fixed_windows(c, armed).collect()}
    assert got == {(a[0], b[0]) for a in rows for b in rows if a[0] % 10 == 0 and abs((a[1] - b[1]).total_seconds()) <= 5.0}


def test_local_levels_stream(spark, tmp_path):
    at = str(tmp_path / "in")
    chunks(spark, [50.0] * 10).select("device_id", "dt_utc", "dba", "lafmax").repartition(1).write.parquet(at)
    source = spark.readStream.schema("device_id string, dt_utc timestamp, dba double, lafmax double").parquet(at)
    q = live.live_levels(source).writeStream.outputMode("complete").format("memory").queryName("lv").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("lv").select(F.sum("chunks")).first()[0] == 10
