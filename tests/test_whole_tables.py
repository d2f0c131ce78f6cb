"""Queries that give each chunk of the table its row."""

import numpy as np

from earshot.operators import dsp
from earshot.plans import queries
from earshot.sources.events import chunks


def test_each_chunk_has_spectrum_and_mel_means(spark, sf_dir):
    pcm = {r["chunk_id"]: np.array(r["pcm"]) for r in dsp.tones(chunks(spark, sf_dir)).collect()}
    made = {name: queries.queries()[name](spark, sf_dir).collect() for name in ("spectrum_bands", "mel_features")}
    for rows in made.values():
        assert len(rows) == len(pcm) == chunks(spark, sf_dir).count() > 64
        assert {r["chunk_id"] for r in rows} == set(pcm)
    for r in made["spectrum_bands"][::97]:
        want = dsp.spectrum(pcm[r["chunk_id"]])
        for k in ("z", "a"):
            assert r[f"levels_{k}"] == ",".join(str(round(v * 10)) for v in want[k]["levels_db"]) and r[f"centroid_{k}"] == want[k]["centroid_hz"] and r[f"mid_{k}"] == want[k]["energy_pct"]["mid"]
    for r in made["mel_features"][::97]:
        mel = dsp.log_mel(pcm[r["chunk_id"]])
        assert r["frames"] == len(mel) and r["mel"] == mel.mean(axis=0).round(6).tolist()
