"""Raw samples as a source, and the chain from samples to events: a stream, also after a restart, gives the events of a batch."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.sources import samples
from earshot.streaming import chain, live

CHUNK = 4800


def signal(seed, chunks, loud=()):
    """32-bit samples of noise with an offset, louder in some chunks, half a chunk more at the end."""
    rng = np.random.default_rng(seed)
    x = 0.01 + 0.001 * rng.standard_normal(int((chunks + 0.5) * CHUNK))
    for k in loud:
        x[k * CHUNK : (k + 1) * CHUNK] += 0.2 * np.sin(2 * np.pi * 1000 * np.arange(CHUNK) / 48000)
    return (x * 2**31).astype("<i4")


RECORDINGS = {"pi__2026-01-15T12-00-00Z.raw": signal(1, 30, (20, 21, 22)), "pi__2026-01-15T13-00-00Z.raw": signal(2, 11, (9,)), "other__2026-01-15T12-00-00Z.raw": signal(3, 25, (5, 15))}


def scorer():
    """What loads a scorer that tells loud from quiet; made here, as workers can't import tests."""

    def load():
        import numpy

        def score(x):
            rms = float(numpy.sqrt(numpy.mean(numpy.square(x))))
            if abs(float(numpy.mean(x))) > 0.01:
                raise ValueError("the offset should be filtered out")
            return [("loud", round(rms, 3)), ("quiet", round(1 - rms, 3)), ("none", 0.0), ("less", -1.0)]

        return score

    return load


def read(spark, at, **options):
    samples.register(spark)
    return spark.read.format("rawsamples").option("chunk", CHUNK).options(**options).load(str(at))


def test_chunks_of_files(spark, tmp_path):
    for name, x in RECORDINGS.items():
        (tmp_path / name).write_bytes(x.tobytes())
    (tmp_path / "notes.txt").write_text("no samples")
    (tmp_path / "pi__2026-01-15T14-00-00Z.raw").write_bytes(b"\x01\x02\x03")
    for step in (1, 7, 64):
        rows = read(spark, tmp_path, range=step).collect()
        assert len(rows) == 30 + 11 + 25
        for r in rows:
            x = RECORDINGS[f"{r['device_id']}__{r['recording_id']}.raw"]
            assert r["samples"] == x[r["chunk_index"] * CHUNK : (r["chunk_index"] + 1) * CHUNK].tolist()
    second = read(spark, tmp_path).filter("device_id = 'other' and chunk_index = 10").select((F.unix_micros("dt_utc") % 60_000_000).alias("us")).first()
    assert second["us"] == 1_000_000
    assert read(spark, tmp_path / "none").count() == 0


def plain(rows):
    """Events as text, numbers to six decimals."""
    out = []
    for r in rows:
        d = json.loads(json.dumps(r.asDict(recursive=True) if hasattr(r, "asDict") else r, default=str), parse_float=lambda v: round(float(v), 6))
        out.append(json.dumps({k: v for k, v in d.items() if v is not None and k != "day"}, sort_keys=True))
    return sorted(out)


@pytest.fixture
def few(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_stream_with_a_restart_gives_the_batch(few, tmp_path):
    spark, at = few, tmp_path / "in"
    at.mkdir()
    samples.register(spark)

    def run():
        source = spark.readStream.format("rawsamples").option("chunk", CHUNK).option("range", 4).load(str(at))
        q = live.write_events(chain.live_events(source, scorer()), str(tmp_path / "out"), str(tmp_path / "ck"))
        q.awaitTermination()

    cuts = {name: int(len(x) * part) for (name, x), part in zip(RECORDINGS.items(), (0.4, 0.0, 0.77))}
    for name, x in RECORDINGS.items():
        if cuts[name]:
            (at / name).write_bytes(x[: cuts[name]].tobytes())
    run()
    for name, x in RECORDINGS.items():
        with open(at / name, "ab") as f:
            f.write(x[cuts[name] :].tobytes())
    run()  # another query from the checkpoint
    run()  # nothing new
    stored = [json.loads(line) for f in (tmp_path / "out").glob("**/*.json") for line in f.read_text().splitlines()]
    batch = chain.batch_events(read(spark, at), scorer())
    want = [json.loads(r) for (r,) in batch.select(F.to_json(F.struct("*"))).collect()]
    assert len(stored) == len(want) == 30 + 11 + 25
    assert plain(stored) == plain(want)
    labels = [r["top_label"] for r in want if r["device_id"] == "other"]
    assert "gated" in labels and {"loud", "quiet"} & set(labels)
    assert next(r for r in want if r["top_label"] == "gated")["predictions"] == [{"label": "gated", "confidence": c} for c in (1.0, 0.0, 0.0)]
    some = next(r for r in want if r["chunk_index"] == 21 and r["device_id"] == "pi")
    assert some["yamnet_preprocess"]["gate_open"] and abs(some["spectrum"]["z"]["peaks"][0]["hz"] - 1000) <= 10 and some["dBA_spl"] > 100
