"""Signals by their properties: tones, clicks, envelopes, chunks; and streams."""

import struct

import numpy as np
import pandas as pd
import pytest

from nearfield.functions import encoders, signal
from nearfield.streaming import incremental

R = signal.RATE


def tone(f, seconds=1.0):
    return 0.5 * np.sin(2 * np.pi * f * np.arange(int(R * seconds)) / R)


def clicks(n=8, gap=0.5):
    y = np.zeros(int(R * n * gap))
    for i in range(n):
        a = int(i * gap * R)
        y[a : a + int(0.02 * R)] += np.random.default_rng(i).normal(0, 0.5, int(0.02 * R))
    return y


@pytest.mark.parametrize("f", [220.0, 330.0, 880.0])
def test_tones(f):
    d = signal.described(tone(f))
    assert d["f0_hz"] == pytest.approx(f, rel=0.01) and d["harmonic_ratio"] >= 0.7 and d["pitch_confidence"] > 0.9
    assert len(d["mfcc_mean"]) == 13 and len(d["spectral_contrast"]) == 7


@pytest.mark.parametrize("n", [1, 3, 7, 31, 33])
def test_running_medians_are_medians(n):
    rng = np.random.default_rng(n)
    for x in (rng.standard_normal((1, 5)), rng.standard_normal((61, 83)).astype("f4"), rng.integers(0, 3, (130, 40)).astype("f4")):
        for axis in (0, 1):
            pad = [(0, 0), (0, 0)]
            pad[axis] = (n // 2, n // 2)
            padded = np.pad(x, pad, mode="reflect" if x.shape[axis] > n // 2 else "edge")
            want = np.median(np.lib.stride_tricks.sliding_window_view(padded, n, axis=axis), axis=-1)
            assert np.array_equal(signal._median(x, n, axis), want)


def test_medians_order_what_windows_share_once(monkeypatch):
    """Steps over whole arrays are by a window's width, not by the number of windows."""
    calls, plain = [], np.median
    monkeypatch.setattr(np, "median", lambda *a, **k: calls.append(a) or plain(*a, **k))
    signal.frame_features(tone(330))
    assert not calls


def test_directions_of_words_are_made_once(monkeypatch):
    made, plain = [], np.random.default_rng
    monkeypatch.setattr(np.random, "default_rng", lambda seed: made.append(seed) or plain(seed))
    encoder = encoders.HashingEncoder()
    a, b = encoder.texts(["onceword otherword", "otherword onceword onceword"])
    assert len(made) == 2 and not np.allclose(a, b)


def test_clicks_have_a_tempo():
    d = signal.described(clicks())
    ratio = d["tempo_bpm"] / 120
    assert min(abs(ratio - x) for x in (0.5, 1.0, 2.0)) < 0.02 and d["onset_count"] >= 4 and d["harmonic_ratio"] < 0.7


def test_levels_and_silence():
    d = signal.described(np.zeros(R // 2))
    assert d["peak_db"] == -120 and d["crest_factor"] is None and d["harmonic_ratio"] is None and d["f0_hz"] is None
    assert signal.described(np.zeros(0)) is None
    pluck = np.exp(-np.arange(R) / R / 0.15) * tone(440)
    d = signal.described(pluck)
    assert d["attack_ms"] < 30 and 250 < d["decay_ms"] < 450


def acid(flags=0, note=60, beats=8, tempo=120.0):
    return struct.pack("<IHHfIHHf", flags, note, 0, 0.0, beats, 4, 4, tempo)


def test_chunks():
    smpl = struct.pack("<9I", 0, 0, 22675, 60, 0, 0, 0, 3, 0) + struct.pack("<6I", 1, 0, 10, 20, 0, 0)
    wave = signal.wave_bytes(tone(220, 0.1), R, {b"acid": acid(signal.ROOT_SET | signal.STRETCH), b"smpl": smpl, b"odd ": b"x"})
    got = signal.embedded(wave)
    assert got["acid"]["beats"] == 8 and got["acid"]["root_set"] and not got["acid"]["one_shot"] and got["acid"]["meter"] == "4/4"
    assert got["smpl"]["unity_note"] == 60 and len(got["smpl"]["loops"]) == 1
    assert signal.loop_chunk(acid(beats=200_000)) is None and signal.loop_chunk(acid(tempo=float("nan"))) is None and signal.loop_chunk(b"x" * 23) is None
    assert signal.embedded(b"junk") == {"smpl": None, "acid": None} == signal.embedded(None)
    assert signal.embedded(wave[:60])["acid"] is None


def test_headers_and_decoding():
    stereo = np.stack([tone(220), 0.5 * tone(220)], axis=1)
    wave = signal.wave_bytes(stereo, 44100)
    assert signal.header(wave) == (pytest.approx(0.5), 44100, 2)
    assert len(signal.decoded(wave)) == pytest.approx(R // 2, abs=2)
    assert np.abs(signal.decoded(wave, rate=None)).max() == pytest.approx(0.375, abs=0.01)
    assert signal.decoded(b"") is None and signal.header(None) is None


def test_rendering():
    wave = signal.wave_bytes(np.ones((R, 2)), R)
    part = signal.decoded(signal.rendered(wave, 500, 5000), rate=None, mono=False)
    assert part.shape == (R // 2, 2) and part[0, 0] == 0 and part[-1, 0] == 0 and part[len(part) // 2, 0] > 0.99
    with pytest.raises(ValueError):
        signal.rendered(wave, 2000, 3000)


def test_spectrogram():
    s = signal.spectrogram(tone(880), 40)
    assert s.shape[1] == 40 and -20 < s.max() <= 1e-6 and s.min() >= -90


def test_files_in_spark(spark):
    files = spark.createDataFrame(pd.DataFrame({"path": ["a", "b", "c"], "content": [signal.wave_bytes(tone(220), R), b"broken", signal.wave_bytes(clicks(), R)]}))
    got = {r.path: r for r in signal.described_files(files).collect()}
    assert got["a"].d.f0_hz == pytest.approx(220, rel=0.01) and got["b"].error == "unreadable" and got["c"].duration_s == pytest.approx(4.0)


def test_encoders(spark):
    e = encoders.HashingEncoder()
    a, b, c = e.texts(["kick drum", "Kick Drum", "pad"])
    assert a @ b == pytest.approx(1) and abs(a @ c) < 0.6 and e.signals([tone(220)]).shape == (1, 64)
    df = spark.createDataFrame([(1, b"ok"), (2, b"")], "id long, content binary")
    got = {r.id: r for r in encoders.captioned(df, lambda: lambda x: bytes(x).decode() if x else 1 / 0, "id", "content").collect()}
    assert got[1].caption == "ok" and "zero" in got[2].error


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 00:10:00", 2.0), (1, "2024-01-01 03:00:00", 4.0), (2, "2024-01-02 00:00:00", 1.0)], "k long, t string, v double").selectExpr("k", "cast(t as timestamp) t", "v")
    folder, check = str(tmp_path / "in"), str(tmp_path / "check")
    rows.coalesce(1).write.parquet(folder)
    seen = []
    assert incremental.new_files(spark, folder, rows.schema, check, lambda df, n: seen.append(df.count())) == 1 and seen == [4]
    assert incremental.new_files(spark, folder, rows.schema, check, lambda df, n: seen.append(df.count())) == 0
    rows.limit(1).coalesce(1).write.mode("append").parquet(folder)
    assert incremental.new_files(spark, folder, rows.schema, check, lambda df, n: seen.append(df.count())) == 1 and seen == [4, 1]
    stream = spark.readStream.schema(rows.schema).parquet(folder)
    for name, df in (("counts", incremental.live_counts(stream, "t", "k", "v")), ("sessions", incremental.live_sessions(stream, "t", "k"))):
        q = df.writeStream.format("memory").queryName(f"s_{name}").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.table(f"s_{name}").count() >= 2


def test_extensible_and_wide_samples():
    import struct

    x = np.array([0.5, -0.25, 0.125], dtype="<f4")
    fmt = struct.pack("<HHIIHH", 0xFFFE, 1, R, R * 4, 4, 32) + struct.pack("<HHI", 22, 32, 4) + struct.pack("<H", 3) + b"\0" * 14
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", 12) + x.tobytes()
    wave = b"RIFF" + struct.pack("<I", len(body)) + body
    assert signal.decoded(wave, rate=None).tolist() == [0.5, -0.25, 0.125]
    assert signal.decoded(wave.replace(struct.pack("<H", 3) + b"\0" * 14, struct.pack("<H", 1) + b"\0" * 14), rate=None)[0] == pytest.approx(0.492, abs=0.001)


def test_resampling_keeps_what_fits_and_no_more():
    t = np.arange(44100) / 44100
    low, high = np.sin(2 * np.pi * 440 * t), np.sin(2 * np.pi * 18000 * t)
    got = signal.resampled(low.astype("float32"), 44100, R)
    assert len(got) == R and np.abs(got[500:-500] - np.sin(2 * np.pi * 440 * np.arange(R) / R)[500:-500]).max() < 0.01
    assert np.abs(signal.resampled(high.astype("float32"), 44100, R)[500:-500]).max() < 0.02


def test_blocks_give_the_whole_spectrum(monkeypatch):
    y = (clicks() + np.resize(tone(330), len(clicks()))).astype("float32")
    one = signal.frame_features(y)
    monkeypatch.setattr(signal, "BLOCK", 7)
    many = signal.frame_features(y)
    for a, b in ((one.mel, many.mel), (one.steady, many.steady), (one.sudden, many.sudden), *((one.features[k], many.features[k]) for k in one.features)):
        assert a == pytest.approx(b, rel=1e-4, abs=1e-4)


def test_a_window_is_described_as_within_the_whole():
    y = np.concatenate([np.zeros(R), tone(440, 1.0), clicks(), tone(220, 1.0)]).astype("float32")
    got = signal.described_window(y, 1000, 2000)
    whole = signal._described(y[R : 2 * R], signal.frame_features(y).part(slice(R // signal.HOP, -(-2 * R // signal.HOP))))
    for key in ("spectral_centroid", "spectral_rolloff", "spectral_flatness", "harmonic_ratio", "rms_db", "f0_hz"):
        assert got[key] == pytest.approx(whole[key], rel=1e-3)
    assert got["f0_hz"] == pytest.approx(440, rel=0.01)
    assert signal.described_window(y, 2000, 2000) is None and signal.described_window(y, 10**6, 10**7) is None


def test_envelopes_by_profile():
    y = clicks().astype("float32")
    tight, energy = signal.envelopes(y, "tight")
    loose, rms = signal.envelopes(y, "loose")
    assert len(tight) == len(energy) and len(loose) == len(rms)
    first = signal.envelopes(tone(440).astype("float32"), "loose")[0]
    assert np.argmax(first) <= signal.LEAD_IN + 1
    swell = (np.linspace(0, 1, R) * tone(440, 1.0)).astype("float32")
    assert signal.envelopes(swell, "loose")[0].sum() > 0.2


def test_beats_of_a_click_train():
    d = signal.described(clicks().astype("float32"))
    ratio = d["beat_bpm"] / d["tempo_bpm"]
    assert min(abs(ratio - r) for r in (0.5, 1.0, 2.0)) < 0.06
    assert signal.beats(np.zeros(100))[0] is None


def test_segments_of_one_file(spark):
    files = spark.createDataFrame(pd.DataFrame({"path": ["a", "b"], "content": [signal.wave_bytes(np.ones(R), R), b"broken"]}))
    cuts = spark.createDataFrame([(1, "a", 0, 100), (2, "a", 100, 300), (3, "a", 2000, 3000), (4, "b", 0, 1)], "id long, path string, start_ms int, end_ms int")
    got = {r.id: (None if r.wave is None else len(signal.decoded(r.wave, rate=None)), r.error) for r in signal.rendered_segments(cuts, files).collect()}
    assert got == {1: (int(0.1 * R), None), 2: (int(0.3 * R) - int(0.1 * R), None), 3: (None, "the segment lies after the end of the file"), 4: (None, "unreadable")}
