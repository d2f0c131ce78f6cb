"""Model plumbing, audio headers and checked parameters."""

import wave

import numpy as np
import pytest

from earshot.operators import models
from earshot.plans import requests
from earshot.sources import audio, flac, labels


def test_scorer_is_plugged_in(spark):
    rows = spark.createDataFrame([(1, [0.1, 0.2]), (2, [])], "chunk_id long, pcm array<double>")

    def load():
        def model(x):
            if not len(x):
                raise ValueError("empty")
            return [("low", float(x.min())), ("high", float(x.max()))]

        return model

    out = models.score(rows, load, top=1).collect()
    assert len(out) == 1 and out[0]["predictions"][0]["label"] == "high"


def test_masks_and_slots():
    m = models.attention_mask(3, 1, slots=2)
    assert m[3].tolist() == [True, True, True, True, False] and m[4].tolist() == [False, False, False, False, True]
    assert models.pad_queries(np.ones((2, 4)), 3).sum() == 8
    with pytest.raises(ValueError):
        models.pad_queries(np.ones((4, 4)), 3)
    stored = {"model_name": "m", "embed_dim": 4, "prompts_hash": "h", "labels": ["a"]}
    assert models.in_sync(stored, "m", 4, "h", ["a"]) and not models.in_sync(stored, "m", 4, "x", ["a"]) and not models.compatible(stored, "m", 5)


def test_stored_embeddings(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", [1.0, 0.0])], "label string, prompt string, embedding array<double>")
    models.save_embeddings(rows, str(tmp_path / "e"), "m", 2, "h")
    assert spark.read.parquet(str(tmp_path / "e")).first()["prompts_hash"] == "h"
    with pytest.raises(ValueError):
        models.save_embeddings(rows, str(tmp_path / "f"), "m", 3, "h")


def test_audio(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(flac.wav_header(3) + audio.to_pcm16(np.array([0.0, 2.0, -2.0])).tobytes())
    with wave.open(str(tmp_path / "a.wav")) as w:
        assert np.frombuffer(w.readframes(3), "<i2").tolist() == [0, 32767, -32767]
    head = b"fLaC" + bytes([0, 0, 0, 34]) + bytes(10) + (48000 << 44 | 7 << 36 | 123456789012 % (1 << 36)).to_bytes(8, "big") + bytes(16)
    assert audio.flac_samples(head) == 123456789012 % (1 << 36) and audio.flac_samples(b"RIFF") is None
    new = audio.patch_flac_samples(head, 46800)
    assert audio.flac_samples(new) == 46800 and new[:18] == head[:18] and new[26:] == head[26:]
    (tmp_path / "b.flac").write_bytes(new)
    assert {r["name"]: r["samples"] for r in audio.audio_files(spark, str(tmp_path)).collect()} == {"a.wav": None, "b.flac": 46800}


def test_requests():
    r = requests.report_request({"files": ["a.jsonl", "a.jsonl"], "max_gap_chunks": -3, "threshold_mode": "l90_offset", "min_confidence": "x"})
    assert r.files == ("a.jsonl",) and r.labels.max_gap == 0 and r.l90_offset == 5.0 and r.labels.min_confidence == 0.25
    for bad in ([], ["../a.jsonl"], [f"{i}.jsonl" for i in range(33)], ["a.txt"]):
        with pytest.raises(ValueError):
            requests.report_request({"files": bad})
    with pytest.raises(ValueError):
        requests.delete_request(["a.jsonl"], active="a.jsonl")
    assert requests.zone("Nowhere/Else")[0] == "Europe/Amsterdam" and requests.zone("UTC") == ("UTC", None)


def stored_model(spark, tmp_path, pairs, name="m", dim=4, queries=None, most=16):
    labels.save_prompts(pairs, str(tmp_path / "prompts.json"))
    rows = spark.createDataFrame([(a, b, [float(k == i) for k in range(dim)]) for i, (a, b) in enumerate(pairs)], "label string, prompt string, embedding array<float>")
    models.save_embeddings(rows, str(tmp_path / "stored"), name, dim, labels.prompts_hash(pairs))
    return models.PromptModel(str(tmp_path / "prompts.json"), str(tmp_path / "stored"), "m", dim, most, queries)


def test_what_keeps_a_model_from_predicting(spark, tmp_path):
    """Missing, of another make, out of sync, too many: each has its own message, and mended files count at once."""
    pairs = [("dog", "a dog"), ("car", "a car")]
    m = stored_model(spark, tmp_path, pairs)
    assert m.problem(spark) is None and m.load(spark)[0] == ["dog", "car"]
    assert "nothing is stored" in models.PromptModel(m.prompts_path, str(tmp_path / "none"), "m", 4).problem(spark)
    labels.save_prompts([*pairs, ("new", "x")], m.prompts_path)
    assert "out of sync" in m.problem(spark)
    with pytest.raises(models.NotReady):
        models.captions(m, spark.createDataFrame([], "chunk_id long, pcm array<double>"), None)
    labels.save_prompts(pairs, m.prompts_path)
    assert m.problem(spark) is None
    assert "of other with 4" in stored_model(spark, tmp_path, pairs, name="other").problem(spark)
    stored_model(spark, tmp_path, pairs)
    assert "rebuild" in models.PromptModel(m.prompts_path, m.embeddings_path, "m", 5).problem(spark)
    assert models.PromptModel(m.prompts_path, m.embeddings_path, "m", 4, most=1).problem(spark)


def test_captions_and_detections(spark, tmp_path):
    pairs = [("dog", "a dog"), ("car", "a car"), ("bell", "a bell")]
    base = spark.createDataFrame([(k, [0.5] * 4) for k in range(5)], "index int, embedding array<float>")
    base.write.parquet(str(tmp_path / "base"))
    m = stored_model(spark, tmp_path, pairs, queries=str(tmp_path / "base"))
    pcm = spark.createDataFrame([(i, [0.1 * i] * 480) for i in range(3)], "chunk_id long, pcm array<double>")

    def towers():
        import numpy

        return lambda mel: numpy.array([0.0, 3.0, 1.0, 0.0])

    got = models.captions(m, pcm, towers, 2).collect()
    assert sorted({(r["rank"], r["label"]) for r in got}) == [(1, "car"), (2, "bell")] and len(got) == 6

    def detector():
        import numpy

        def predict(mel, query, mask):
            assert mel.shape == (1001, 64) and query.shape == (5 + 16, 4) and mask.shape == (21, 21) and not query[8:].any()
            strong, weak = numpy.zeros((1, 21, 50)), numpy.zeros((1, 21))
            strong[0, 5, 10:20], strong[0, 5, 30], strong[0, 7, 48:] = 0.8, 0.9, 0.6
            weak[0, 5:8], weak[0, 20] = (0.4, 0.1, 0.7), 1.0
            return strong, weak

        return predict

    r = models.detections(m, pcm, detector).orderBy("chunk_id").collect()
    assert len(r) == 3 and (r[0]["top_label"], r[0]["top_confidence"]) == ("bell", 0.7)
    spans = {x["label"]: [(s["t0_s"], s["t1_s"], s["confidence"]) for s in x["spans"]] for x in r[0]["labels"]}
    assert spans == {"dog": [(0.2, 0.4, 0.8), (0.6, 0.62, 0.9)], "car": [], "bell": [(0.96, 1.0, 0.6)]}
    assert [x["label"] for x in r[0]["labels"]] == ["bell", "dog", "car"]
    base.withColumn("embedding", models.F.array(models.F.lit(0.5).cast("float"))).write.mode("overwrite").parquet(str(tmp_path / "base"))
    assert "base queries" in m.problem(spark)
    with pytest.raises(models.NotReady):
        models.detections(stored_model(spark, tmp_path, pairs), pcm, detector)


def test_last_lines_of_long_files(spark, tmp_path, monkeypatch):
    from earshot.sources import events

    lines = [f'{{"k": {i}, "pad": "{"ä" * (i % 50)}"}}' for i in range(2000)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n\n")
    (tmp_path / "b.jsonl").write_text("one\r\n\ntwo")
    (tmp_path / "c.jsonl").write_text("")
    got = {}
    for r in events.tail_lines(spark, str(tmp_path), 7).orderBy("place").collect():
        got.setdefault(r["source_file"], []).append(r["raw"])
    assert got == {"a.jsonl": lines[-7:], "b.jsonl": ["one", "two"]}
    for part in (1, 100, 5000, 1 << 20):
        assert events._last_lines(str(tmp_path / "a.jsonl"), 320, part) == lines[-320:] and events._last_lines(str(tmp_path / "a.jsonl"), 0, part) == []


def test_assets_that_are_missing(spark, tmp_path):
    (tmp_path / "a.onnx").write_bytes(b"x" * 10)
    (tmp_path / "b.json").write_bytes(b"")
    got = models.assets(spark, str(tmp_path), ["a.onnx", "b.json", "c.npz"])
    assert got == {"ready": False, "missing": ["b.json", "c.npz"], "bytes": {"a.onnx": 10}}
    assert models.assets(spark, str(tmp_path), ["a.onnx"])["ready"] and models.assets(spark, str(tmp_path / "none"), ["a"])["missing"] == ["a"]
