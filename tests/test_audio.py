"""FLAC and WAV from executors, decoded by a plain reader, and waveforms cut to the sample."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.operators import capture
from earshot.sources import audio, flac


def decode(data):
    """Samples of a mono FLAC file, bit by bit, with all its checks."""
    assert data[:4] == b"fLaC" and data[4] == 0x80
    word = struct.unpack(">Q", data[18:26])[0]
    bits, total = (word >> 36 & 31) + 1, word & (1 << 36) - 1
    at, out, number = 42, [], 0
    while at < len(data):
        start = at
        assert data[at : at + 4] == b"\xff\xf8\x70\x00"
        lead = data[at + 4]
        more = 0 if lead < 0x80 else next(k for k in range(1, 7) if not lead >> (6 - k) & 1)
        value = lead if not more else lead & (0x3F >> more)
        for b in data[at + 5 : at + 5 + more]:
            value = value << 6 | b & 0x3F
        assert value == number
        at += 5 + more
        n = struct.unpack(">H", data[at : at + 2])[0] + 1
        assert flac.crc8(data[start : at + 2]) == data[at + 2]
        at += 3
        text, p = "".join(f"{b:08b}" for b in data[at : at + 2 * n * bits // 8 + 600]), 0

        def take(k, signed=False):
            nonlocal p
            v = int(text[p : p + k] or "0", 2)
            p += k
            return v - (1 << k) if signed and v >> (k - 1) else v

        kind = take(8) >> 1
        if kind == 0:
            x = [take(bits, True)] * n
        elif kind == 1:
            x = [take(bits, True) for _ in range(n)]
        else:
            order = kind - 8
            x = [take(bits, True) for _ in range(order)]
            assert take(2) == 0
            depth = take(4)
            for part in range(1 << depth):
                k = take(4)
                for _ in range((n >> depth) - (order if part == 0 else 0)):
                    q = text.index("1", p) - p
                    p += q + 1
                    v = q << k | take(k)
                    v = -(v + 1) // 2 if v & 1 else v // 2
                    x.append(v + sum(c * y for c, y in zip(((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))[order], x[::-1])))
        at += -(-p // 8)
        assert flac.crc16(data[start:at]) == struct.unpack(">H", data[at : at + 2])[0]
        at += 2
        out += x
        number += 1
    assert len(out) == total
    return np.array(out)


@pytest.mark.parametrize("kind", ["tone", "noise", "silence", "steps", "edges", "short", "one", "none"])
def test_encoder(kind):
    rng = np.random.default_rng(1)
    n = 9000
    x = {
        "tone": 9000 * np.sin(np.arange(n) / 20), "noise": rng.integers(-32768, 32768, n), "silence": np.zeros(n), "steps": np.repeat(rng.integers(-900, 900, 90), 100), "edges": np.where(np.arange(n) % 1000 < 3, 32767, -32768),
        "short": rng.integers(-5, 5, 300), "one": np.array([-7]), "none": np.zeros(0),
    }[kind].astype(np.int64)
    e = flac.Encoder()
    data = flac.header(len(x)) + b"".join(e.add(x[k : k + 1111]) for k in range(0, len(x), 1111)) + e.add(np.zeros(0), end=True)
    assert np.array_equal(decode(data), x) and audio.flac_samples(data[:42]) == len(x)
    assert len(data) < {"tone": 0.7, "silence": 0.01, "steps": 0.5}.get(kind, 1.02) * 2 * len(x) + 100


def test_numbers_of_frames():
    assert [flac._utf8(n) for n in (0, 127, 128, 2047, 2048, 65535, 65536)] == [chr(n).encode("utf-8", "surrogatepass") for n in (0, 127, 128, 2047, 2048, 65535, 65536)]
    assert flac._utf8(1 << 30)[0] == 0xFC | 1 and flac._utf8(1 << 31)[0] == 0xFE


def recordings(spark, n=5):
    rng = np.random.default_rng(2)
    rows = [(d, r, i, (0.3 * rng.standard_normal(1500 + 100 * i)).tolist()) for d, r in (("a", "x"), ("a", "y/z"), (None, "x")) for i in range(n)]
    return rows, spark.createDataFrame(rows, "device_id string, recording_id string, chunk_index int, pcm array<double>").repartition(6)


@pytest.mark.parametrize("kind", ["flac", "wav"])
def test_executors_write_recordings(spark, tmp_path, kind):
    rows, pcm = recordings(spark)
    audio.write_recordings(pcm, str(tmp_path / "out"), kind, chunks_per_file=3)
    found = {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()}
    assert sorted(found) == sorted(f"{d}__{r}{part}.{kind}" for d, r in (("a", "x"), ("a", "y-z"), ("none", "x")) for part in ("", ".1"))
    for name, data in found.items():
        device, rest = name.split("__")
        part = int(rest.split(".")[1]) if rest.count(".") == 2 else 0
        x = np.concatenate([audio.to_pcm16(np.array(p)) for d, r, i, p in rows if (d or "none") == device and r.replace("/", "-") == rest.split(".")[0] and i // 3 == part])
        got = decode(data) if kind == "flac" else np.frombuffer(data, "<i2", offset=44)
        assert np.array_equal(got, x)
        assert kind == "flac" or struct.unpack("<I", data[40:44])[0] == 2 * len(x) == len(data) - 44
    if kind == "flac":
        counts = {r["name"]: r["samples"] for r in audio.audio_files(spark, str(tmp_path / "out")).collect()}
        assert counts == {name: audio.flac_samples(data[:42]) for name, data in found.items()}


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    _, pcm = recordings(spark)
    broken = pcm.withColumn("pcm", F.when((F.col("chunk_index") == 4) & (F.col("recording_id") == "x"), F.raise_error(F.lit("no more")).cast("array<double>")).otherwise(F.col("pcm")))
    at = tmp_path / "out"
    with pytest.raises(Exception):  # noqa: B017
        audio.write_recordings(broken, str(at))
    assert not at.exists() or not list(at.iterdir())
    with pytest.raises(Exception):  # noqa: B017
        audio.write_recordings(pcm, str(at), "mp3")


RATE, CHUNK = 48_000, 2400


def wave_rows(spark, lengths):
    rng = np.random.default_rng(5)
    whole = {(d, r): rng.standard_normal(n) for (d, r), n in lengths.items()}
    rows = [(d, r, k // CHUNK, k // CHUNK, x[k : k + CHUNK].tolist()) for (d, r), x in whole.items() for k in range(0, len(x), CHUNK)]
    return whole, spark.createDataFrame(rows, "device_id string, recording_id string, chunk_index int, chunk_id long, pcm array<double>").repartition(5)


def test_fixed_windows_to_the_sample(spark):
    """Windows as long as their parameters say, padded with zeros on both ends, for all devices."""
    whole, pcm = wave_rows(spark, {("a", "1"): 20 * CHUNK, ("b", "1"): 9 * CHUNK + 77, (None, None): CHUNK})
    armed = pcm.filter("chunk_index in (0, 3, 8, 19)")
    out = capture.waveforms(pcm, capture.fixed_samples(armed, 0.2, 0.3, CHUNK, RATE), CHUNK).collect()
    assert len(out) == armed.count() == 8
    for r in out:
        x = whole[r["device_id"], r["recording_id"]]
        end = (r["armed_id"] + 1) * CHUNK
        pre, post = x[max(0, end - 9600) : end], x[end : end + 14400]
        if end > len(x):  # the armed chunk itself is short
            pre = np.concatenate((x[max(0, end - 9600) :], np.zeros(end - len(x))))
        want = np.concatenate((np.zeros(9600 - len(pre)), pre, post, np.zeros(14400 - len(post))))
        assert len(r["pcm"]) == round(0.5 * RATE) and np.array_equal(r["pcm"], want)
        assert r["missing"] == sum(not 0 <= k < len(x) for k in range(end - 9600, end + 14400))


def test_waveforms_of_captures(spark):
    """From the onset with its pad to the end, and no longer than the longest event."""
    whole, pcm = wave_rows(spark, {("a", "1"): 20 * CHUNK})
    given = [(6, 0.15, 0.4), (6, 0.333, 0.2), (1, 0.5, 0.35)]  # the last reaches back before the recording
    armed = spark.createDataFrame([("a", "1", i, c, lead, s) for i, (c, lead, s) in enumerate(given)], "device_id string, recording_id string, chunk_id long, chunk_index int, lead_s double, event_seconds double")
    out = {r["armed_id"]: r for r in capture.waveforms(pcm, capture.dynamic_samples(armed, CHUNK, RATE), CHUNK).collect()}
    for i, (c, lead, s) in enumerate(given):
        first = max(0, (c + 1) * CHUNK - round(lead * RATE))
        assert np.array_equal(out[i]["pcm"], whole["a", "1"][first : first + round(s * RATE)]) and out[i]["missing"] == 0
    assert capture.waveforms(pcm, capture.dynamic_samples(armed.limit(0), CHUNK, RATE), CHUNK).count() == 0
