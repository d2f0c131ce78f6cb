"""Log-mel frames in parts that fit a core's cache: the frames of the plain definition."""

import numpy as np
import pytest

from earshot.operators import dsp


def plain(x, power, rate=48_000, size=1024, hop=480, bands=64):
    padded = np.pad(x, size // 2, "reflect")
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / (size if power else size - 1))
    mag = np.abs(np.fft.rfft([padded[k : k + size] * window for k in range(0, len(padded) - size + 1, hop)]))
    bank = dsp.mel_bank(rate, size, bands, 50.0, 14_000.0)
    return np.log(np.maximum(mag**2 @ bank.T, 1e-10)) if power else np.log10(np.maximum(mag @ bank.T, 1e-10))


@pytest.mark.parametrize("together", [1, 10_000, 1 << 16])
@pytest.mark.parametrize("power", [True, False])
def test_parts_give_the_frames_of_the_whole(monkeypatch, together, power):
    monkeypatch.setattr(dsp, "_TOGETHER", together)
    x = np.random.default_rng(6).standard_normal((9, 4800)) * np.geomspace(1e-7, 1, 9)[:, None]
    made = dsp.log_mels(x, power=power)
    assert made.shape == (9, 11, 64) and np.allclose(made, [plain(row, power) for row in x], rtol=0, atol=1e-11)
    assert dsp.log_mels(x[:0], power=power).shape == (0, 11, 64)


def test_tones_by_their_definition():
    ids, dba = np.arange(120), np.linspace(30, 90, 120)
    hz = 100.0 * (1 + ids % 50)
    assert np.array_equal(dsp.tone_of(ids, dba), 10.0 ** ((dba - 120.0) / 20)[:, None] * np.sin(2 * np.pi * hz[:, None] * np.arange(4800) / 48_000))
