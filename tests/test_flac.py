"""FLAC streams of every kind of subframe, decoded to what was written."""

import numpy as np
import pytest

from nearfield.functions import flac, signal
from tests.flac_writer import flac as written

RNG = np.random.default_rng(4)


def wave(n, bits=16):
    t = np.arange(n)
    return (np.sin(t / 9) * 0.6 * 2 ** (bits - 1) + RNG.integers(-40, 40, n)).astype(np.int64)


PLAIN = (0, False, 0)


@pytest.mark.parametrize("kind", ["verbatim", 0, 1, 2, 3, 4, ((1800, -900, 60), 10), ((3, -3, 1), 0)], ids=str)
@pytest.mark.parametrize("bits", [8, 16, 24])
def test_subframes(kind, bits):
    x = wave(4 * 300, bits)[:, None]
    content = written([(x[:800], 0, [(kind, False, 0)]), (x[800:], 0, [(kind, True, 0)])], 44100, bits)
    stream = flac.stream_of(content)
    assert (stream.rate, stream.channels, stream.bits, stream.total) == (44100, 1, bits, 1200)
    assert np.concatenate(list(flac.frames_of(content, stream))).tolist() == x.tolist()
    assert signal.decoded(content, rate=None) == pytest.approx(x[:, 0] / 2 ** (bits - 1), abs=1e-6)


@pytest.mark.parametrize("channel", [1, 8, 9, 10])
def test_stereo(channel):
    x = np.stack([wave(577), wave(577) // 3 - 7], axis=1)
    content = written([(x, channel, [(2, False, 0), (1, False, 0)])], 48000, 16)
    assert next(flac.frames_of(content, flac.stream_of(content))).tolist() == x.tolist()
    assert signal.decoded(content, rate=None, mono=False).shape == (577, 2)
    assert signal.header(content) == (pytest.approx(577 / 48000), 48000, 2)


def test_constant_wasted_bits_and_what_is_cut_off():
    x = np.full((64, 1), -1024)
    y = wave(256)[:, None] << 3 & 0x7FF8
    content = written([(x, 0, [("constant", False, 0)]), (y, 0, [(2, False, 3)]), (y, 0, [PLAIN])], 8000, 16)
    stream = flac.stream_of(content)
    got = list(flac.frames_of(content, stream))
    assert got[0].tolist() == x.tolist() and got[1].tolist() == y.tolist() and got[2].tolist() == y.tolist()
    cut = list(flac.frames_of(content[:-100], stream))
    assert len(cut) == 2 and flac.stream_of(b"fLaC") is None and flac.stream_of(b"RIFF") is None
    assert signal.decoded(b"fLaC" + bytes(50)) is None


def test_a_tone_is_described_as_its_wave_is(spark):
    import pandas as pd

    y = 0.5 * np.sin(2 * np.pi * 330 * np.arange(signal.RATE) / signal.RATE)
    x = np.round(y * 32767).astype(np.int64)[:, None]
    blocks = [(x[i : i + 4096], 0, [(2, False, 0)]) for i in range(0, len(x), 4096)]
    files = spark.createDataFrame(pd.DataFrame({"path": ["a.flac", "a.wav"], "content": [written(blocks, signal.RATE, 16), signal.wave_bytes(y, signal.RATE)]}))
    a, b = sorted(signal.described_files(files).collect())
    assert a.error is None and a.d.f0_hz == pytest.approx(b.d.f0_hz, rel=1e-3) and a.d.rms_db == pytest.approx(b.d.rms_db, abs=0.01)
    assert (a.duration_s, a.sample_rate, a.channels) == (b.duration_s, b.sample_rate, b.channels)
