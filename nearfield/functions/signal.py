"""Signals: RIFF reading, decoding, frame features, onsets, periodicity, pitch, as Arrow UDFs over NumPy.

Re-made from the published definitions (STFT, median-filtered harmonic and
percussive parts, mel cepstra, spectral moments, YIN); results are held to
properties (a tone's pitch, a click train's tempo), not to another library's bits.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions import flac

RATE, FRAME, HOP, ENV_FRAME, ENV_HOP = 22050, 2048, 512, 512, 64
PITCH_MIN, PITCH_MAX = 40.0, 2000.0
_MOST_CHUNK = 1 << 20
#: Frames of silence before detection, and of context around an excerpt (more than a median's reach).
LEAD_IN, CONTEXT = 4, 32
#: Bits of the loop chunk's flags.
ONE_SHOT, ROOT_SET, STRETCH, ACIDIZED = 1, 2, 4, 16


# Reading


def riff_chunks(content: bytes) -> Iterator[tuple[bytes, bytes, int]]:
    """(id, body, declared size) of a WAVE file's chunks; nothing for other files; a truncated body comes as it is."""
    if len(content) < 12 or content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        return
    at = 12
    while at + 8 <= len(content):
        size = int.from_bytes(content[at + 4 : at + 8], "little")
        yield content[at : at + 4], content[at + 8 : at + 8 + size], size
        at += 8 + size + (size & 1)


def sampler_chunk(body: bytes) -> dict | None:
    """Unity note, sample period and those loops that fit into the body."""
    if len(body) < 36:
        return None
    fields = struct.unpack_from("<9I", body)
    loops = [dict(zip(("id", "type", "start", "end", "fraction", "play_count"), struct.unpack_from("<6I", body, 36 + 24 * i), strict=True)) for i in range(min(fields[7], (len(body) - 36) // 24))]
    return {"unity_note": fields[3], "sample_period": fields[2], "loops": loops}


def loop_chunk(body: bytes) -> dict | None:
    """Flags, root note, beats, meter and tempo; none if beats or tempo make no sense."""
    if len(body) < 24:
        return None
    flags, note, _, _, beats, low, high, tempo = struct.unpack_from("<IHHfIHHf", body)
    if beats > 100_000 or not 0.0 <= tempo <= 1000.0:
        return None
    return {"one_shot": bool(flags & ONE_SHOT), "root_set": bool(flags & ROOT_SET), "stretch": bool(flags & STRETCH), "acidized": bool(flags & ACIDIZED), "root_note": note, "beats": beats, "meter": f"{high}/{low}", "tempo": float(tempo)}


def embedded(content: bytes | None) -> dict:
    """The first sampler and loop chunks of a file, of 1 MiB at most; never raises."""
    out: dict = {"smpl": None, "acid": None}
    for name, body, size in riff_chunks(content or b""):
        key = {b"smpl": "smpl", b"acid": "acid"}.get(name)
        if key and out[key] is None and size <= _MOST_CHUNK:
            out[key] = (sampler_chunk if key == "smpl" else loop_chunk)(body)
    return out


def header(content: bytes | None) -> tuple[float, int, int] | None:
    """(seconds, rate, channels) of a WAVE or FLAC file."""
    content = content or b""
    if content[:4] == b"fLaC" and len(content) >= 42:
        bits = int.from_bytes(content[18:26], "big")
        rate, channels, total = bits >> 44, (bits >> 41 & 7) + 1, bits & (1 << 36) - 1
        return (total / rate, rate, channels) if rate else None
    fmt, data = None, None
    for name, body, size in riff_chunks(content):
        if name == b"fmt " and len(body) >= 16 and fmt is None:
            fmt = struct.unpack_from("<HHIIHH", body)
        elif name == b"data" and data is None:
            data = len(body)
    if fmt is None or data is None or not fmt[2] or not fmt[4]:
        return None
    return data / fmt[4] / fmt[2], fmt[2], fmt[1]


#: Frames of sound, and frames of a spectrum, that are worked on at once.
SAMPLES, BLOCK = 1 << 16, 128
#: The last two bytes of a sub-format's first four: what WAVE_FORMAT_EXTENSIBLE stands for.
_EXTENSIBLE = 0xFFFE


def _samples(data: bytes, kind: int, bits: int) -> np.ndarray | None:
    if bits == 16:
        return np.frombuffer(data, "<i2") / np.float32(32768)
    if bits == 8:
        return np.frombuffer(data, "u1") / np.float32(128) - np.float32(1)
    if bits == 24:
        raw = np.frombuffer(data, "u1").reshape(-1, 3).astype(np.int32)
        return ((raw[:, 0] << 8 | raw[:, 1] << 16 | raw[:, 2] << 24) >> 8) / np.float32(8388608)
    if bits == 32:
        return np.frombuffer(data, "<f4").astype(np.float32) if kind == 3 else (np.frombuffer(data, "<i4") / 2147483648.0).astype(np.float32)
    if bits == 64 and kind == 3:
        return np.frombuffer(data, "<f8").astype(np.float32)
    return None


def resampled(x: np.ndarray, own: int, rate: int, reach: int = 16) -> np.ndarray:
    """One channel at another rate, by a windowed sinc that lets nothing pass above either rate's half; in blocks."""
    cut = min(1.0, rate / own)
    taps = np.arange(-int(reach / cut), int(reach / cut) + 1)
    padded = np.pad(x, len(taps))
    out = np.empty(int(len(x) * rate / own), dtype=np.float32)
    for begin in range(0, len(out), SAMPLES):
        at = np.arange(begin, min(len(out), begin + SAMPLES)) * (own / rate)
        near = np.floor(at).astype(np.int64)
        d = (at - near)[:, None] - taps
        weight = cut * np.sinc(cut * d) * np.cos(np.pi / 2 * np.clip(d / (reach / cut + 1), -1, 1)) ** 2
        out[begin : begin + len(at)] = (padded[near[:, None] + taps + len(taps)] * weight).sum(axis=1) / np.maximum(weight.sum(axis=1), 1e-9)
    return out


def decoded(content: bytes | None, rate: int | None = RATE, mono: bool = True) -> np.ndarray | None:
    """PCM or float samples in -1..1 at a rate, read in blocks; None for what can't be read (WAVE files of 8 to 32 bits or of floats, and FLAC, are)."""
    x, own = _flac(content or b"", mono) if (content or b"")[:4] == b"fLaC" else _wave(content or b"", mono)
    if x is None:
        return None
    if rate and rate != own and len(x):
        x = np.stack([resampled(c, own, rate) for c in x.T], axis=1)
    return x[:, 0] if mono else x


def _flac(content: bytes, mono: bool) -> tuple[np.ndarray | None, int]:
    stream = flac.stream_of(content)
    if stream is None:
        return None, 0
    parts = [(x.mean(axis=1, keepdims=True) if mono else x).astype(np.float32) / np.float32(1 << stream.bits - 1) for x in flac.frames_of(content, stream)]
    return (np.concatenate(parts) if parts else None), stream.rate


def _wave(content: bytes, mono: bool) -> tuple[np.ndarray | None, int]:
    fmt, data, sub = None, None, 0
    for name, body, _ in riff_chunks(content):
        if name == b"fmt " and len(body) >= 16:
            fmt = struct.unpack_from("<HHIIHH", body)
            sub = struct.unpack_from("<H", body, 24)[0] if len(body) >= 26 else 0
        elif name == b"data" and data is None:
            data = body
    if fmt is None or data is None or not fmt[1] or not fmt[2]:
        return None, 0
    kind, channels, own, _, _, bits = fmt
    kind, align = sub if kind == _EXTENSIBLE else kind, channels * (bits // 8)
    if bits % 8 or not align:
        return None, 0
    whole = len(data) // align * align
    parts = []
    for begin in range(0, max(whole, 1), SAMPLES * align):
        x = _samples(data[begin : min(whole, begin + SAMPLES * align)], kind, bits)
        if x is None:
            return None, 0
        x = x.reshape(-1, channels)
        parts.append(x.mean(axis=1, keepdims=True) if mono else x)
    return np.concatenate(parts), own


def wave_bytes(y: np.ndarray, rate: int, extra: dict[bytes, bytes] | None = None) -> bytes:
    """A 16-bit WAVE file of frames or (frames, channels), with further chunks."""
    y = np.atleast_2d(np.asarray(y, dtype=float).T).T
    data = (np.clip(y, -1, 1) * 32767).round().astype("<i2").tobytes()
    channels = y.shape[1]
    chunks = {b"fmt ": struct.pack("<HHIIHH", 1, channels, rate, rate * channels * 2, channels * 2, 16), **(extra or {}), b"data": data}
    body = b"WAVE" + b"".join(k + struct.pack("<I", len(v)) + v + b"\0" * (len(v) & 1) for k, v in chunks.items())
    return b"RIFF" + struct.pack("<I", len(body)) + body


# Frames


def frames(y: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Centred frames, zero padded."""
    y = np.pad(y, size // 2)
    if len(y) < size:
        y = np.pad(y, (0, size - len(y)))
    return np.lib.stride_tricks.sliding_window_view(y, size)[::hop]


def rms_envelope(y: np.ndarray, size: int = ENV_FRAME, hop: int = ENV_HOP) -> np.ndarray:
    all_ = frames(y, size, hop)
    return np.concatenate([np.sqrt((all_[i : i + 4096].astype(float) ** 2).mean(axis=1)) for i in range(0, len(all_), 4096)])


def _ascending(rows: list[np.ndarray]) -> list[np.ndarray]:
    """Arrays of one shape in order at each place, by Batcher's odd-even merging of any number of them."""
    rows, n = list(rows), len(rows)
    p = 1
    while p < n:
        k = p
        while k:
            for j in range(k % p, n - k, 2 * k):
                for i in range(j, min(j + k, n - k)):
                    if i // (2 * p) == (i + k) // (2 * p):
                        rows[i], rows[i + k] = np.minimum(rows[i], rows[i + k]), np.maximum(rows[i], rows[i + k])
            k //= 2
        p *= 2
    return rows


def _ranked(a: list[np.ndarray], b: list[np.ndarray], ranks: range) -> list[np.ndarray]:
    """What has these ranks, from 0, in two ordered lists of arrays together: of the ways to take so many from both, the least greatest one."""
    out = []
    for r in ranks:
        best = None
        for i in range(max(0, r + 1 - len(b)), min(len(a), r + 1) + 1):
            top = b[r - i] if i == 0 else a[i - 1] if i == r + 1 else np.maximum(a[i - 1], b[r - i])
            best = top if best is None else np.minimum(best, top)
        out.append(best)
    return out


def _running_median(x: np.ndarray, n: int) -> np.ndarray:
    """The median of each n rows (an odd number) that follow each other, by column.

    Windows go in groups of a power of two, whose common rows are ordered once.  A
    group's halves each share some rows more, which are merged into what is ordered
    already, and of that only those ranks go on that the rows still missing leave in
    question; at last a window has one row more.  All groups are worked on at once.
    """
    if n == 1:
        return x.copy()
    count = len(x) - n + 1
    size = 1 << ((n + 1) // 2).bit_length() - 1
    groups = -(-count // size)
    x = np.concatenate([x, np.zeros((groups * size + n - 1 - len(x), *x.shape[1:]), x.dtype)])
    out = np.empty((groups * size, *x.shape[1:]), x.dtype)

    def halved(kept: list[np.ndarray], size: int, begin: int, step: int, below: int) -> None:
        """Windows begin, begin + step ..: groups of `size` of them, their common rows' ranks from `below` on."""
        if size == 1:
            out[begin::step] = kept[0]
            return
        half = size // 2
        row = lambda i: x[begin + i : begin + i + (groups - 1) * step + 1 : step]
        for at, first in ((0, half - 1), (half, n)):
            more = _ascending([row(first + i) for i in range(half)])
            # half - 1 rows are still missing then: ranks lower or higher by more than that can't be the middle
            ranks = range(max(0, n // 2 - half + 1 - below), min(len(kept) + half, n // 2 + 1 - below))
            halved(_ranked(kept, more, ranks), half, begin + at, step, below + ranks.start)

    core = _ascending([x[i : i + (groups - 1) * size + 1 : size] for i in range(size - 1, n)])
    ranks = range(max(0, n // 2 - size + 1), min(len(core), n // 2 + 1))
    halved(core[ranks.start : ranks.stop], size, 0, size, ranks.start)
    return out[:count]


def _median(x: np.ndarray, n: int, axis: int) -> np.ndarray:
    pad = [(0, 0), (0, 0)]
    pad[axis] = (n // 2, n // 2)
    padded = np.pad(x, pad, mode="reflect" if x.shape[axis] > n // 2 else "edge")
    return _running_median(padded, n) if axis == 0 else _running_median(np.ascontiguousarray(padded.T), n).T


def harmonic_percussive(power: np.ndarray, n: int = 31, own: slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
    """Soft masks of steady and of sudden parts of a magnitude spectrogram (frames, bins), for its own frames: medians along time and along frequency."""
    h, p = _median(power, n, 0)[own] ** 2, _median(power[own], n, 1) ** 2
    total = h + p
    return np.divide(h, total, out=np.full_like(h, 0.5), where=total > 0), np.divide(p, total, out=np.full_like(p, 0.5), where=total > 0)


def spectra(y: np.ndarray, context: int = 15) -> Iterator[tuple[np.ndarray, slice]]:
    """Magnitudes of BLOCK frames at a time, with the frames around that a median reads, and which rows are the block's own.

    A long file's whole spectrum is never held.
    """
    all_ = frames(y, FRAME, HOP)
    window = np.hanning(FRAME + 1)[:-1].astype(np.float32)
    for begin in range(0, len(all_), BLOCK):
        end = min(len(all_), begin + BLOCK)
        # at an end of the file as many rows again, so that they are mirrored there as they would be in the whole
        first, last = max(0, begin - 2 * context), min(len(all_), end + 2 * context)
        yield np.abs(np.fft.rfft(all_[first:last] * window, axis=1)), slice(begin - first, end - first)


def _mel_bank(n: int = 128) -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(RATE / 2), n + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FRAME, 1 / RATE)
    up, down = (f - edges[:-2, None]) / np.diff(edges)[:-1, None], (edges[2:, None] - f) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


_MEL = _mel_bank()
_DCT = np.cos(np.pi / 128 * (np.arange(128) + 0.5)[None, :] * np.arange(13)[:, None]) * np.sqrt(2 / 128)
_DCT[0] /= np.sqrt(2)


@dataclass
class Frames:
    """What is kept of each frame of a buffer."""

    mel: np.ndarray  # levels in dB, without a floor
    percussive_mel: np.ndarray
    steady: np.ndarray  # energies of both parts
    sudden: np.ndarray
    features: dict[str, np.ndarray]

    def part(self, rows: slice) -> Frames:
        return Frames(self.mel[rows], self.percussive_mel[rows], self.steady[rows], self.sudden[rows], {k: v[rows] for k, v in self.features.items()})


def _level(power: np.ndarray) -> np.ndarray:
    return (10 * np.log10(np.maximum(1e-10, power @ _MEL.T))).astype(np.float32)


def frame_features(y: np.ndarray) -> Frames:
    """One pass over a buffer's spectrum, block by block."""
    rows: dict[str, list[np.ndarray]] = {}
    for magnitude, own in spectra(y):
        h, p = harmonic_percussive(magnitude, own=own)
        m = magnitude[own]
        found = {"mel": _level(m**2), "percussive_mel": _level((m * p) ** 2), "steady": ((m * h) ** 2).sum(axis=1), "sudden": ((m * p) ** 2).sum(axis=1), **_shape_features(m)}
        for k, v in found.items():
            rows.setdefault(k, []).append(v)
    all_ = {k: np.concatenate(v) for k, v in rows.items()}
    return Frames(all_.pop("mel"), all_.pop("percussive_mel"), all_.pop("steady"), all_.pop("sudden"), all_)


def cepstra(mel: np.ndarray) -> np.ndarray:
    return np.maximum(mel, mel.max() - 80) @ _DCT.T


def _shape_features(magnitude: np.ndarray) -> dict[str, np.ndarray]:
    """By frame: contrast, centroid, bandwidth, rolloff, flatness."""
    f = np.fft.rfftfreq(FRAME, 1 / RATE)
    power = magnitude**2
    total = np.maximum(magnitude.sum(axis=1), 1e-12)
    centroid = magnitude @ f / total
    edges = np.concatenate([[0], 200 * 2.0 ** np.arange(7)])
    contrast = []
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        band = np.sort(magnitude[:, (f >= low) & (f <= min(high, RATE / 2))], axis=1)
        n = max(1, round(0.02 * band.shape[1]))
        level = lambda x: 10 * np.log10(np.maximum(1e-10, x.mean(axis=1) ** 2))
        contrast.append(level(band[:, -n:]) - level(band[:, :n]))
    return {
        "contrast": np.stack(contrast, axis=1),
        "centroid": centroid,
        "bandwidth": np.sqrt((magnitude * (f[None, :] - centroid[:, None]) ** 2).sum(axis=1) / total),
        "rolloff": f[(np.cumsum(magnitude, axis=1) >= 0.85 * magnitude.sum(axis=1, keepdims=True)).argmax(axis=1)],
        "flatness": np.exp(np.log(np.maximum(power, 1e-10)).mean(axis=1)) / np.maximum(power, 1e-10).mean(axis=1),
    }


def onset_strength(mel: np.ndarray) -> np.ndarray:
    """Rises of mel levels over the local maximum of the frame before."""
    level = np.maximum(mel, mel.max() - 80)
    before = np.maximum(np.maximum(level, np.roll(level, 1, axis=1)), np.roll(level, -1, axis=1))
    return np.concatenate([[0.0], np.maximum(0, level[1:] - before[:-1]).mean(axis=1)])


def envelopes(y: np.ndarray, profile: str) -> tuple[np.ndarray, np.ndarray]:
    """(onset, energy) envelopes by frame for detection: `tight` hears rises in the sudden part's spectrum, `loose` rises of energy.

    A few frames of silence come first, so that a sound at the very start rises, too.
    """
    y = np.concatenate([np.zeros(LEAD_IN * HOP, dtype=np.float32), y])
    energy = rms_envelope(y, FRAME, HOP)
    if profile == "loose":
        return np.maximum(0.0, np.diff(energy, prepend=energy[:1])), energy
    found = frame_features(y)
    return onset_strength(found.percussive_mel), np.sqrt(found.sudden / FRAME)


def beats(strength: np.ndarray, tightness: float = 100.0) -> tuple[float | None, np.ndarray]:
    """(tempo, frames): a chain of frames that are strong and evenly spaced, found by dynamic programming.

    The spacing aimed at is the best autocorrelation weighted towards 120 a
    minute; the tempo is the median spacing of what was found.
    """
    fps = RATE / HOP
    if len(strength) < 3 * fps * 60 / 240 or strength.max() <= 0:
        return None, np.zeros(0, dtype=int)
    x = strength / strength.std()
    lags = np.arange(round(fps * 60 / 240), min(len(x) - 1, round(fps * 60 / 40)) + 1)
    ac = np.fft.irfft(np.abs(np.fft.rfft(x - x.mean(), 2 * len(x))) ** 2)[lags]
    aim = int(lags[np.argmax(np.maximum(ac, 0) * np.exp(-0.5 * np.log2(60 * fps / lags / 120) ** 2))])
    steps = np.arange(-2 * aim, -aim // 2)
    cost = -tightness * np.log(-steps / aim) ** 2
    total, back = x.copy(), np.full(len(x), -1)
    for i in range(len(x)):
        ok = i + steps >= 0
        if ok.any():
            score = total[i + steps[ok]] + cost[ok]
            best = int(np.argmax(score))
            if score[best] > 0:
                total[i], back[i] = x[i] + score[best], i + steps[ok][best]
    out, at = [], int(np.argmax(total))
    while at >= 0:
        out.append(at)
        at = int(back[at])
    out = np.array(out[::-1])
    return (60 * fps / float(np.median(np.diff(out))) if len(out) > 1 else None), out


def onset_frames(strength: np.ndarray, wait: int = 2, reach: int = 3, above: float = 0.07) -> np.ndarray:
    """Frames that are local maxima and stand above the local mean."""
    if not len(strength) or strength.max() <= 0:
        return np.zeros(0, dtype=int)
    x = strength / strength.max()
    out: list[int] = []
    for i in range(len(x)):
        a, b = max(0, i - reach), i + reach + 1
        if x[i] == x[a:b].max() and x[i] >= x[max(0, i - 8) : i + 9].mean() + above and (not out or i - out[-1] > wait):
            out.append(i)
    return np.array(out, dtype=int)


def periodicity(strength: np.ndarray, bounds: tuple[float, float] = (40.0, 240.0), detrend_s: float = 1.0) -> tuple[float | None, float | None]:
    """(confidence, tempo): the highest genuine local peak of the detrended autocorrelation, its lag refined by a parabola."""
    if len(strength) < 8 or not strength.any():
        return None, None
    fps = RATE / HOP
    n = max(3, round(fps * detrend_s))
    x = strength - np.convolve(np.pad(strength, (n // 2, n - 1 - n // 2), mode="edge"), np.ones(n) / n, mode="valid")
    ac = np.fft.irfft(np.abs(np.fft.rfft(x, 2 * len(x))) ** 2)[: len(x)]
    if ac[0] <= 0:
        return None, None
    ac = ac / ac[0]
    low, high = max(2, round(fps * 60 / bounds[1])), min(len(ac) - 2, round(fps * 60 / bounds[0]))
    if high <= low:
        return None, None
    lags = np.arange(low + 1, high)
    peaks = lags[(ac[lags] > ac[lags - 1]) & (ac[lags] > ac[lags + 1]) & (ac[lags] >= 0)]
    if not len(peaks):
        return 0.0, None
    lag = int(peaks[np.argmax(ac[peaks])])
    a, b, c = ac[lag - 1 : lag + 2]
    bend = a - 2 * b + c
    return float(np.clip(b, 0, 1)), 60 * fps / (lag + float(np.clip(0.5 * (a - c) / bend if bend else 0.0, -0.5, 0.5)))


def pitch(y: np.ndarray, threshold: float = 0.1) -> tuple[float | None, float | None]:
    """(median f0, share of frames within a semitone) by YIN; missing below a tenth of a second or without frames in range."""
    if len(y) < RATE // 10:
        return None, None
    low, high = int(RATE / PITCH_MAX), int(RATE / PITCH_MIN) + 1
    width, lags = FRAME - high, np.arange(high + 1)
    f0, all_ = [], frames(y, FRAME, HOP)
    for begin in range(0, len(all_), BLOCK):
        part = all_[begin : begin + BLOCK]
        # a lag and a place in the window end within the frame, so nothing wraps round
        spectrum = np.fft.rfft(part, axis=1)
        product = np.fft.irfft(spectrum * np.conj(np.fft.rfft(part[:, :width], FRAME, axis=1)), axis=1)[:, : high + 1]
        energy = np.pad(np.cumsum(part**2, axis=1), ((0, 0), (1, 0)))
        d = energy[:, width, None] + (energy[:, lags + width] - energy[:, lags]) - 2 * product
        mean = np.cumsum(np.maximum(d[:, 1:], 0), axis=1)
        d = np.pad(d[:, 1:] * lags[1:] / np.maximum(mean, 1e-12), ((0, 0), (1, 0)), constant_values=1.0)
        below = d[:, low:high] < threshold
        first = low + np.where(below.any(axis=1), below.argmax(axis=1), d[:, low:high].argmin(axis=1))
        for own, lag in zip(d[mean[:, -1] > 1e-9], first[mean[:, -1] > 1e-9], strict=True):
            while lag + 1 < high and own[lag + 1] < own[lag]:
                lag += 1
            a, b, c = own[lag - 1], own[lag], own[min(high, lag + 1)]
            bend = a - 2 * b + c
            f0.append(RATE / (lag + (float(np.clip(0.5 * (a - c) / bend, -0.5, 0.5)) if bend else 0.0)))
    f0 = np.array([f for f in f0 if PITCH_MIN <= f <= PITCH_MAX])
    if not len(f0):
        return None, None
    mid = float(np.median(f0))
    return mid, float(np.mean((f0 >= mid * 2 ** (-1 / 12)) & (f0 <= mid * 2 ** (1 / 12))))


def described(y: np.ndarray | None) -> dict | None:
    """Descriptors of a buffer: levels, envelope times, spectrum, onsets, tempo, and pitch where it is harmonic."""
    return _described(y, frame_features(y)) if y is not None and len(y) else None


def described_window(y: np.ndarray, start_ms: float, end_ms: float) -> dict | None:
    """Descriptors of a part of a file from an excerpt on the file's own frames, with CONTEXT frames on each side, so that frames inside are what they are in the whole; None for an empty part."""
    start, end = max(0, int(start_ms * RATE / 1000)), min(len(y), int(end_ms * RATE / 1000))
    if end <= start:
        return None
    low, high = max(0, start // HOP - CONTEXT) * HOP, min(len(y), (-(-end // HOP) + CONTEXT) * HOP)
    rows = slice((start - low) // HOP, max((start - low) // HOP + 1, -(-(end - low) // HOP)))
    return _described(y[start:end], frame_features(y[low:high]).part(rows))


def _described(y: np.ndarray, found: Frames) -> dict:
    strength = onset_strength(found.mel)
    at = onset_frames(strength)
    env = rms_envelope(y)
    loud = [env[max(0, f * 8 - 20) : f * 8 + 21].max(initial=0) >= 0.2 * env.max() for f in at]
    times = [float(f * HOP / RATE) for f, ok in zip(at, loud, strict=True) if ok and strength[f] >= 0.3 * strength[at].max()]
    eh, ep = float(found.steady.sum()), float(found.sudden.sum())
    share = eh / (eh + ep) if eh + ep > 0 else None
    confidence, tempo = periodicity(strength)
    beat = beats(strength)[0] if confidence else None
    f0, agreement = pitch(y) if share is not None and share >= 0.7 else (None, None)
    peak, rms = float(np.abs(y).max()), float(np.sqrt((y.astype(float) ** 2).mean()))
    db = lambda v: max(-120.0, 20 * float(np.log10(v))) if v > 0 else -120.0
    top = int(np.argmax(env))
    before, after = np.flatnonzero(env[:top] < env[top] * 0.1), np.flatnonzero(env[top:] <= env[top] * 0.1)
    ms = ENV_HOP / RATE * 1000
    mfcc = cepstra(found.mel)
    return {
        "peak_db": db(peak), "rms_db": db(rms), "crest_factor": peak / rms if rms > 0 else None, "attack_ms": (top - (int(before[-1]) + 1 if len(before) else 0)) * ms, "decay_ms": float(after[0]) * ms if len(after) else None,
        "f0_hz": f0, "pitch_confidence": agreement, "harmonic_ratio": share, "tempo_bpm": tempo, "tempo_confidence": confidence, "beat_bpm": beat, "onset_count": len(times), "onsets": times,
        "mfcc_mean": mfcc.mean(axis=0).tolist(), "mfcc_var": mfcc.var(axis=0).tolist(), "spectral_contrast": found.features["contrast"].mean(axis=0).tolist(),
        **{f"spectral_{k}": float(found.features[k].mean()) for k in ("centroid", "bandwidth", "rolloff", "flatness")},
    }


SCHEMA = "peak_db double, rms_db double, crest_factor double, attack_ms double, decay_ms double, f0_hz double, pitch_confidence double, harmonic_ratio double, tempo_bpm double, tempo_confidence double, beat_bpm double, onset_count int, onsets array<double>, mfcc_mean array<double>, mfcc_var array<double>, spectral_contrast array<double>, spectral_centroid double, spectral_bandwidth double, spectral_rolloff double, spectral_flatness double"
_ACID = "one_shot boolean, root_set boolean, stretch boolean, acidized boolean, root_note int, beats long, meter string, tempo double"
_SMPL = "unity_note long, sample_period long, loops array<struct<id:long,type:long,start:long,end:long,fraction:long,play_count:long>>"


def _struct(spec: str) -> str:
    return "struct<" + ", ".join(f"{n}:{t}" for n, t in (x.split(" ", 1) for x in spec.split(", "))) + ">"


def described_files(files: DataFrame) -> DataFrame:
    """(path, duration_s, sample_rate, channels, smpl, acid, d, error) of files (path, content): one decoding serves all; a file that fails is a row with its error."""
    schema = f"path string, duration_s double, sample_rate int, channels int, smpl {_struct(_SMPL)}, acid {_struct(_ACID)}, d {_struct(SCHEMA)}, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                row = dict.fromkeys(("duration_s", "sample_rate", "channels", "smpl", "acid", "d", "error"))
                row["path"] = path
                try:
                    row |= embedded(content)
                    if head := header(content):
                        row["duration_s"], row["sample_rate"], row["channels"] = head
                    row["d"] = described(decoded(content))
                    row["error"] = None if row["d"] else "unreadable"
                except Exception as e:  # one bad file doesn't end a run
                    row["error"] = f"{type(e).__name__}: {e}"[:200]
                yield pd.DataFrame([row])

    return files.select("path", "content").mapInPandas(run, schema)


def spectrogram(y: np.ndarray, rows: int, size: int = 2048) -> np.ndarray:
    """Levels below the loudest, to -90 dB, on `rows` log-spaced frequencies (low first) by frame; size 256 to 2048."""
    size = int(np.clip(size, 256, 2048))
    m = np.abs(np.fft.rfft(frames(y, size, size // 4) * np.hanning(size + 1)[:-1], axis=1))
    db = 20 * np.log10(np.maximum(m, 1e-12) / max(m.max(), 1e-12))
    at = np.geomspace(1, m.shape[1] - 1, rows).round().astype(int)
    return np.maximum(db, -90)[:, at]


def opened(content: bytes) -> tuple[np.ndarray, int]:
    """A file's samples at its own rate and channels, and that rate."""
    head, y = header(content), decoded(content, rate=None, mono=False)
    if head is None or y is None:
        raise ValueError("unreadable")
    return y, head[1]


def cut(y: np.ndarray, rate: int, start_ms: int, end_ms: int) -> bytes:
    """A part with short fades, as a WAVE file; ends with the whole; refused if it begins after it."""
    part = y[int(start_ms * rate / 1000) : int(end_ms * rate / 1000)].copy()
    if not len(part):
        raise ValueError("the segment lies after the end of the file")
    for ms, ramp in ((2, lambda n: np.linspace(0, 1, n)), (20, lambda n: np.linspace(1, 0, n))):
        n = min(int(ms * rate / 1000), len(part) // 2)
        if n:
            side = slice(0, n) if ms == 2 else slice(len(part) - n, None)
            part[side] *= ramp(n)[:, None].astype(part.dtype)
    return wave_bytes(part, rate)


def rendered(content: bytes, start_ms: int, end_ms: int) -> bytes:
    return cut(*opened(content), start_ms, end_ms)


def rendered_segments(segments: DataFrame, files: DataFrame) -> DataFrame:
    """(id, wave, error) of segments (id, path, start_ms, end_ms) cut from files (path, content); a file is sent and decoded once for all its segments.

    Rows with contents are many times as large as a plan takes them for, so neither side is broadcast.
    """
    cuts = segments.groupBy("path").agg(F.collect_list(F.struct("id", "start_ms", "end_ms")).alias("cuts"))
    kind = segments.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content, own in zip(b["content"], b["cuts"], strict=True):
                try:
                    sound = opened(content)
                except Exception as e:
                    yield pd.DataFrame([(c["id"], None, str(e)[:200]) for c in own], columns=["id", "wave", "error"])
                    continue
                for c in own:
                    try:
                        row = (c["id"], cut(*sound, c["start_ms"], c["end_ms"]), None)
                    except Exception as e:
                        row = (c["id"], None, str(e)[:200])
                    yield pd.DataFrame([row], columns=["id", "wave", "error"])

    return cuts.join(files.hint("merge"), "path").select("content", "cuts").mapInPandas(run, f"id {kind}, wave binary, error string")
