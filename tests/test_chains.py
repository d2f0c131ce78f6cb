"""Chains from samples to a model's input, pluggable encoders, stored embeddings and configurations."""

import hashlib
import json

import numpy as np
import pytest

from earshot.operators import dsp, models
from earshot.sources import events, labels


def tone(seconds, hz=440.0, amp=0.1):
    return amp * np.sin(2 * np.pi * hz * np.arange(int(seconds * dsp.RATE)) / dsp.RATE)


def test_shapes_and_windows():
    for x in (np.zeros(0), tone(0.5), tone(10), tone(11)):
        assert dsp.caption_mel(x).shape == (1001, 64) and dsp.detector_mel(x).shape == (1001, 64) and dsp.classifier_wave(x).shape == (15_600,)
    loud = dsp.caption_mel(np.concatenate((np.zeros(dsp.RATE), tone(10))))  # the last ten seconds: no silence
    assert loud.max(axis=1).min() > -5
    assert np.allclose(dsp.detector_mel(tone(10)), dsp.detector_mel(tone(10, amp=0.3)), atol=1e-3)  # peak-normalised
    tail = dsp.detector_mel(tone(2))
    assert tail[300:].max() <= -9.9 and tail[:190].max() > 0  # zeros after the samples
    assert dsp.classifier_wave(tone(0.975), gain=100.0).max() <= 1.1
    assert dsp.fit_window(np.arange(3.0), 7, True).tolist() == [0, 1, 2, 0, 1, 2, 0]
    norm = {"mean": np.ones(64), "var": np.full(64, 3.0), "weight": np.full(64, 2.0), "bias": np.full(64, 0.5), "eps": 1.0}
    assert np.allclose(dsp.detector_mel(tone(1), norm), dsp.detector_mel(tone(1)) - 0.5, atol=1e-5)


def test_mel_bank_by_its_rule():
    """The bank bin by bin, as its definition says."""
    rate, size, bands = 48_000, 1024, 64
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = [700 * (10 ** (m / 2595) - 1) for m in np.linspace(mel(50.0), mel(14_000.0), bands + 2)]
    bins = [int((size + 1) * f // rate) for f in edges]
    bank = dsp.mel_bank(rate, size, bands, 50.0, 14_000.0)
    for k in range(bands):
        a, b, c = bins[k : k + 3]
        b += b == a
        c += c == b
        for j in range(size // 2 + 1):
            want = (j - a) / (b - a) if a <= j < b else (c - j) / (c - b) if b <= j < c else 0.0
            assert abs(bank[k, j] - want * 2 / (edges[k + 2] - edges[k])) < 1e-12


def test_chains_and_windows_in_spark(spark):
    pcm = spark.createDataFrame([("d", i, tone(0.4).tolist()) for i in range(3)], "device_id string, chunk_id long, pcm array<double>")
    out = dsp.prepared(pcm, "classifier").collect()
    assert [len(r["features"]) for r in out] == [15_600] * 3
    assert dsp.prepared(pcm.limit(0), "caption").count() == 0
    whole = np.concatenate([tone(0.4)] * 3)
    got = sorted(dsp.rechunked(pcm, 25_000).collect(), key=lambda r: r["window"])
    assert len(got) == 2 and np.allclose(np.concatenate([r["pcm"] for r in got]), whole[:50_000])
    assert dsp.chunk_stats(np.array([0.0, -0.5])) == {"peak": 0.5, "rms": pytest.approx(0.5 / np.sqrt(2))} and dsp.chunk_stats([])["rms"] == 0.0


def test_encoders_and_stored_embeddings(spark, tmp_path):
    pairs = [("a", "dog barks"), ("b", "car")]
    prompts = spark.createDataFrame(pairs, "label string, prompt string")
    load = lambda: lambda texts: np.array([[len(t), 1.0, 0.0] for t in texts])
    digest, at = labels.prompts_hash(pairs), str(tmp_path / "e")
    assert models.rebuild(prompts, at, None, load, "m", 3, digest, ["a", "b"])
    rows, made = models.load_embeddings(spark, at, 3)
    assert made == {"model_name": "m", "embed_dim": 3, "prompts_hash": digest} and rows.count() == 2
    assert all(abs(np.linalg.norm(r["embedding"]) - 1) < 1e-6 for r in rows.collect())
    assert not models.rebuild(prompts, at, made | {"labels": ["a", "b"]}, load, "m", 3, digest, ["a", "b"])
    with pytest.raises(ValueError):
        models.load_embeddings(spark, at, 4)
    pcm = spark.createDataFrame([(1, tone(0.1).tolist())], "chunk_id long, pcm array<double>")
    vec = models.embed_audio(pcm, lambda: lambda mel: mel.mean(axis=0), "caption").first()["embedding"]
    assert len(vec) == 64 and abs(np.linalg.norm(vec) - 1) < 1e-5
    mels = spark.createDataFrame([(7, np.zeros(6).tolist())], "chunk_id long, features array<float>")
    out = models.detect(mels, lambda: lambda m: (np.tile([[0.1], [0.9], [0.5]], 4), np.array([0.2, 0.8, 0.9])), ["x", "y"], (2, 3)).collect()
    assert [(r["label"], r["clip_confidence"]) for r in out] == [("y", 0.8), ("x", 0.2)] and out[0]["scores"] == [0.9] * 4
    (tmp_path / "m.onnx").write_bytes(b"z" * 2_000_000)
    want = hashlib.sha256(b"z" * (1 << 20) + b"2000000").hexdigest()[:12]
    assert models.fingerprints(spark, str(tmp_path / "m.onnx")).first()["fingerprint"] == want


def test_configurations_come_back(tmp_path):
    at = str(tmp_path / "t.json")
    (tmp_path / "t.json").write_text(json.dumps({"trigger_labels": [" Car", "Dog", "dog "], "ambiguous_labels": ["Hum", "Car"], "suppress_labels": ["DOG"], "cooldown_seconds": 7}))
    t = labels.load_trigger_config(at)
    assert (t.trigger, t.ambiguous, t.cooldown_s, t.lookback_s) == (("Car",), ("Hum",), 7.0, 4.0)
    labels.save_trigger_config(t, at)
    assert labels.load_trigger_config(at) == t
    w = labels.WindowConfig(pre_roll_s=-1, frame_threshold=3.0, min_span_s=-2, frames_per_second=0).normalised()
    assert (w.pre_roll_s, w.frame_threshold, w.min_span_s, w.frames_per_second) == (0.1, 1.0, 0.0, 1.0)
    labels.save_window_config(w, at)
    assert labels.load_window_config(at) == w and labels.load_window_config(str(tmp_path / "none.json")) == labels.WindowConfig()
    labels.save_prompts([("a", "x"), ("b", "y")], at, 16)
    assert labels.load_prompts(at, 16) == [("a", "x"), ("b", "y")]
    with pytest.raises(ValueError):
        labels.save_prompts([("a", "x")] * 2, at)


def test_catalog_of_files(spark, tmp_path):
    line = {"device_id": "pi", "created_at": "2026-07-15T12:00:00Z", "dBA_spl": 50, "chunk_index": 9, "clap_status": "gated"}
    (tmp_path / "a.jsonl").write_text(json.dumps(line) + "\n{bad\n" + json.dumps(line | {"created_at": "2026-07-15T13:00:05Z", "chunk_index": 12}))
    (tmp_path / "b.jsonl").write_text("")
    stored = events.read_jsonl(spark, str(tmp_path)).withColumn("dt_utc", events.parse_created(events.F.col("created_at")))
    files = spark.createDataFrame([("a.jsonl", 200, 5), ("b.jsonl", 0, 9), ("a.flac", 7, 5)], "name string, bytes long, m long").selectExpr("name", "bytes", "timestamp_seconds(m) AS modified")
    rows = events.catalog(stored, files).collect()
    assert [r["name"] for r in rows] == ["b.jsonl", "a.jsonl"] and rows[0]["lines"] == 0 and rows[0]["heavy_ml"] == "off"
    a = rows[1]
    assert (a["lines"], a["duration_s"], a["duration"], a["heavy_ml"], a["audio"], a["bytes"]) == (13, 3605, "1 h 0 min", "clap", "a.flac", 200)
    assert a["started"] == "2026-07-15 14:00 CEST"
    narrow = events.read_for_report(spark, str(tmp_path))
    assert narrow.count() == 2 and narrow.columns == ["source_file", *events.REPORT_COLUMNS]
    edge = events.bounds(stored.drop("raw"), events.F.col("chunk_index")).first()
    assert (edge["first"]["chunk_index"], edge["last"]["chunk_index"]) == (9, 12)


def test_configuration_of_the_captions(tmp_path):
    """Defaults, a file over them, and what it changes."""
    assert dsp.load_caption_config(str(tmp_path / "none.json")) == dsp.CaptionConfig()
    (tmp_path / "c.json").write_text(json.dumps({"hop_length": "960", "feature_size": 32, "frequency_max": 8000, "padding": "repeatpad", "nb_max_samples": None}))
    c = dsp.load_caption_config(str(tmp_path / "c.json"))
    assert (c.hop_length, c.feature_size, c.frequency_max, c.samples) == (960, 32, 8000.0, 480_000)
    assert dsp.caption_mel(tone(1), c).shape == (501, 32) and dsp.caption_mel(tone(1)).shape == (1001, 64)
    assert np.allclose(dsp.caption_mel(tone(10)), dsp.log_mel(tone(10)), atol=1e-5)


def test_kinds_of_audio():
    from earshot.sources import audio

    assert [audio.audio_kind(x) for x in (" FLAC ", "wav", "mp3", None, "")] == ["flac", "wav", "flac", "flac", "flac"] and audio.audio_suffix("Flac") == ".flac"
