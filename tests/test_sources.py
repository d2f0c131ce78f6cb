"""JSON Lines with odd lines, listings, exports and label settings."""

import json

import pytest
from pyspark.sql import functions as F

from earshot.operators import overview, votes
from earshot.sources import events, labels


@pytest.fixture
def stored(spark, tmp_path):
    full = {
        "device_id": "pi", "created_at": "2026-01-15T12:00:00.000Z", "chunk_index": 0, "recording_id": "r", "dBA_spl": "61.2", "LAFmax_dB": 65, "top_label": "Vehicle", "top_confidence": 0.8,
        "yamnet_preprocess": {"gated": False, "gate_open": True, "ambient_noise_floor_dbfs": -70.0, "calibration_offset_db": 120.0}, "clap_status": "triggered", "clap_top_label": "a car", "clap_meta": {"event_seconds": 2.5},
        "spectrum": {"a": {"centroid_hz": 900.0, "energy_pct": {"low": 10.0, "mid": 60.0, "high": 30.0}}},
        "dasm": {"status": "triggered", "top_label": "x", "labels": [{"label": "x", "clip_confidence": 0.5, "spans": []}, {"label": "", "clip_confidence": 0.1, "spans": []}]},
    }
    lines = [json.dumps(full), "", "{broken", "[1]", json.dumps({"created_at": 5, "dBA_spl": 50}), json.dumps({"created_at": "2026-01-15T12:00:01Z", "run_id": "old", "recording_id": "", "dBA_spl": 55.5, "top_label": "gated"})]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    return events.read_jsonl(spark, str(tmp_path / "a.jsonl"))


def test_tolerant_reader(stored):
    rows = stored.collect()
    assert len(rows) == 3 and rows[0]["dBA_spl"] == 61.2 and rows[1]["created_at"] is None
    assert [r[0] for r in stored.select(events.recording_id()).collect()] == ["r", None, "old"]
    c = events.chunks_from_events(stored, offset=1.0).orderBy("dt_utc").collect()
    assert [(r["dba"], r["gated"]) for r in c] == [(62.2, False), (56.5, True)] and c[0]["dt_local"].hour == 13


def test_report_reads_the_same_rows(spark, stored, tmp_path):
    """Levels stored as text, labels that are numbers, broken and nested lines: the narrow reader keeps what the other one keeps."""
    odd = ['{"dBA_spl":"61.2","top_confidence":"0.5"}', '{"dBA_spl":50,"top_label":5,"created_at":"x"}', '{"dBA_spl":[1],"yamnet_preprocess":{"gated":"yes"}}', '  {"dBA_spl":null} ', '{"dBA_spl":1', '"text"', "7", "null", '{"yamnet_preprocess":7,"LAFmax_dB":{"a":1}}', '{"yamnet_preprocess":{"gated":true,"more":[1]}}']
    (tmp_path / "odd.jsonl").write_text("\n".join(odd))
    wide = events.read_jsonl(spark, str(tmp_path))
    narrow = events.read_for_report(spark, str(tmp_path))
    same = wide.select("source_file", *[F.struct(F.col("yamnet_preprocess.gated").alias("gated")).alias(c) if c == "yamnet_preprocess" else F.col(c) for c in events.REPORT_COLUMNS])
    key = lambda df: sorted(str({k: (v if not isinstance(v, dict) or v["gated"] is not None else None) for k, v in r.asDict(recursive=True).items()}) for r in df.collect())
    assert key(narrow) == key(same) and narrow.count() == 3 + 6
    assert {r["top_label"] for r in narrow.collect()} == {None, "Vehicle", "gated"}


def test_points_and_markers(stored):
    p = overview.slim_points(stored, 2.0).orderBy("ms").collect()[0]
    assert (p["dba"], p["l90_rel"], p["gate_open"], p["event_seconds"]) == (63.2, 50.0, True, 2.5)
    assert [x["label"] for x in p["dasm_labels"]] == ["x"] and p["spectrum_bands"]["mid"] == 60.0
    assert overview.markers(overview.slim_points(stored)).first()["label"] == "a car"
    assert {r["label"]: r["rows"] for r in overview.multilabel_counts(stored).collect()} == {"x": 1}


def test_listing_and_export(spark, stored, tmp_path):
    r = events.recordings(stored).first()
    assert (r["lines"], r["heavy_ml"]) == (3, "dasm")
    events.export(stored, str(tmp_path / "out"), spectrum=False)
    keys = set(json.loads(next(iter(spark.read.text(str(tmp_path / "out")).first()))))
    assert "spectrum" not in keys and "yamnet_preprocess" in keys
    names = spark.createDataFrame([("a.jsonl",), ("b.jsonl",)], "name string")
    audio = spark.createDataFrame([("a.wav",), ("a.flac",), ("c.wav",)], "name string")
    assert {x["name"]: x["audio"] for x in events.with_audio(names, audio).collect()} == {"a.jsonl": "a.flac", "b.jsonl": None}


def test_settings(tmp_path, spark):
    t = labels.TriggerConfig(trigger=(" Car", "Car", ""), ambiguous=("Hum", "Car")).normalised()
    assert t.trigger == ("Car",) and t.ambiguous == ("Hum",)
    with pytest.raises(ValueError):
        labels.check_prompts([("a", "x"), ("a", "y")])
    assert len(labels.prompts_hash([("a", "ü")])) == 16
    (tmp_path / "m.json").write_text(json.dumps({"min_confidence": 0.5, "segmentation": {"max_gap_chunks": 4}}))
    m = labels.load_label_map(str(tmp_path / "m.json"))
    assert (m.min_confidence, m.max_gap, m.min_chunks) == (0.5, 4, 2)
    (tmp_path / "c.csv").write_text('index,mid,display_name\n0,/m/1,Speech\n1,/m/2,"Child speech, kid speaking"\n2,/m/3,Vacuum cleaner\n')
    named = labels.theme_of(labels.read_class_map(spark, str(tmp_path / "c.csv")))
    assert [r["theme"] for r in named.orderBy("index").collect()] == ["Human voice", "Human voice", "Tools and industry"]


def test_votes_leave_out(spark):
    rows = [(i, label, conf, gated, None) for i, (label, conf, gated) in enumerate([("Vehicle", 0.25, False), ("Vehicle", 0.2, False), ("Door", 0.9, False), ("Speech", 0.9, True), ("n/a", 0.9, False), (None, 0.9, False), ("Toilet seat", 0.9, False)])]
    out = votes.with_votes(spark.createDataFrame(rows, "chunk_id long, top_label string, top_confidence double, gated boolean, clap_status string")).orderBy("chunk_id").collect()
    assert [r["vote"] for r in out] == ["Vehicle", None, None, None, None, None, None]
    assert out[0]["macro"] == "Traffic & Transit" and out[3]["category"] == "Relative silence"


def test_themes_by_one_automaton(spark, tmp_path):
    """The first rule with a keyword inside the name decides, in any script; equal to trying each keyword in turn."""
    (tmp_path / "rules.csv").write_text('rule,theme,keyword\n0,Vehicles,train\n0,Vehicles," Car "\n1,Weather,rain\n1,Weather,дождь\n2,Tools,vacuum\n3,Tiere,"hund, groß"\n3,Tiere,\n1,Weather,car\n')
    rules = labels.read_theme_rules(spark, str(tmp_path / "rules.csv"))
    names = ["Train horn", "Heavy RAIN", "Vacuum cleaner", "Brain", "Дождь", "Hund, groß", "carpet", "none", "", None, "rain on a train", "Heavy RAIN"]
    classes = spark.createDataFrame([(i, f"/m/{i}", n) for i, n in enumerate(names)], "index int, mid string, display_name string")
    got = {r["index"]: r["theme"] for r in labels.theme_catalog(classes, rules).collect()}
    table = sorted((r["rule"], r["theme"], r["keyword"]) for r in rules.collect())
    assert len(table) == 7
    for i, n in enumerate(names):
        assert got[i] == next((t for _, t, w in table if w in (n or "").lower()), "Other"), n
    assert {r["theme"] for r in labels.theme_catalog(classes, rules.limit(0)).collect()} == {"Other"}
    assert {r["index"]: r["theme"] for r in labels.theme_catalog(classes).collect()} == {r["index"]: r["theme"] for r in labels.theme_of(classes).collect()}
    with pytest.raises(ValueError):
        labels.theme_catalog(classes, spark.range(labels.MOST_KEYWORDS + 1).selectExpr("0 AS rule", "'x' AS theme", "string(id) AS keyword"))


def test_votes_look_labels_up(spark):
    """A catalog's themes decide macros and what never votes; a label that it lacks has no theme."""
    from test_levels import chunks as made

    rows = made(spark, [50.0] * 4).withColumn("top_label", F.element_at(F.array(*map(F.lit, ("Train horn", "Kettle", "Unheard", "Printer"))), (F.col("chunk_id") + 1).cast("int")))
    catalog = spark.createDataFrame([("Train horn", "Vehicles"), ("Kettle", "Domestic / interior"), ("Printer", "Tools and industry")], "display_name string, theme string")
    got = {r["chunk_id"]: (r["theme"], r["vote"], r["category"]) for r in votes.with_votes(rows, catalog=catalog).collect()}
    assert got == {0: ("Vehicles", "Train horn", "Traffic & Transit"), 1: ("Domestic / interior", None, labels.UNCLASSIFIED), 2: (None, "Unheard", labels.UNCLASSIFIED), 3: ("Tools and industry", None, labels.UNCLASSIFIED)}
