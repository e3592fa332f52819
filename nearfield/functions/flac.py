"""Decoding FLAC streams, from the published format (RFC 9639)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

# Fixed values of the format: predictors of the fixed subframes, and widths by sample size code.
_FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
_WIDTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


@dataclass(frozen=True)
class Stream:
    rate: int
    channels: int
    bits: int
    total: int
    longest: int
    begin: int


def stream_of(content: bytes) -> Stream | None:
    """The stream's properties and where its frames begin; None for what isn't FLAC."""
    if content[:4] != b"fLaC":
        return None
    at, found = 4, None
    while at + 4 <= len(content):
        last, kind, size = content[at] >> 7, content[at] & 127, int.from_bytes(content[at + 1 : at + 4], "big")
        if kind == 0 and len(content) >= at + 38:
            body = content[at + 4 : at + 4 + size]
            packed = int.from_bytes(body[10:18], "big")
            found = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, int.from_bytes(body[2:4], "big")
        at += 4 + size
        if last:
            break
    return Stream(*found, at) if found and found[0] else None


class _Bits:
    """Bits of a part of the content, from a byte on: single numbers, and many at once."""

    def __init__(self, data: bytes) -> None:
        raw = np.frombuffer(data + bytes(16), dtype=np.uint8)
        self.words = np.ndarray((len(data) + 8,), dtype=">u8", buffer=raw, strides=(1,))
        bits = np.unpackbits(raw[:-8])
        at = np.where(bits, np.arange(len(bits)), len(bits))
        # by place, the next set bit
        self.next_one = np.minimum.accumulate(at[::-1])[::-1].tolist()
        self.at, self.end = 0, 8 * len(data)

    def many(self, at: np.ndarray, width: int) -> np.ndarray:
        if not width:
            return np.zeros(len(at), dtype=np.int64)
        return (self.words[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64) >> np.uint64(64 - width)).astype(np.int64)

    def take(self, width: int) -> int:
        if self.at + width > self.end:
            raise EOFError
        out = int(self.many(np.array([self.at]), width)[0])
        self.at += width
        return out

    def signed(self, width: int, count: int) -> np.ndarray:
        if self.at + width * count > self.end:
            raise EOFError
        out = self.many(self.at + width * np.arange(count), width)
        self.at += width * count
        return out - ((out >> (width - 1) & 1) << width) if width else out

    def unary(self) -> int:
        one = self.next_one[self.at]
        out, self.at = one - self.at, one + 1
        if self.at > self.end:
            raise EOFError
        return out

    def rice(self, width: int, count: int) -> np.ndarray:
        ones, at, following = [], self.at, self.next_one
        for _ in range(count):
            one = following[at]
            ones.append(one)
            at = one + 1 + width
        if at > self.end:
            raise EOFError
        ones = np.array(ones, dtype=np.int64)
        starts = np.concatenate([[self.at], ones[:-1] + 1 + width]) if count else ones
        folded = (ones - starts << width) + self.many(ones + 1, width)
        self.at = at
        return folded >> 1 ^ -(folded & 1)


def _residual(bits: _Bits, size: int, order: int) -> np.ndarray:
    wide = 5 if bits.take(2) else 4
    parts = bits.take(4)
    out = []
    for n in range(1 << parts):
        count = (size >> parts) - (order if n == 0 else 0)
        width = bits.take(wide)
        out.append(bits.signed(bits.take(5), count) if width == (1 << wide) - 1 else bits.rice(width, count))
    return np.concatenate(out)


def _subframe(bits: _Bits, size: int, width: int) -> np.ndarray:
    bits.take(1)
    kind = bits.take(6)
    wasted = bits.unary() + 1 if bits.take(1) else 0
    width -= wasted
    if kind == 0:
        out = np.repeat(bits.signed(width, 1), size)
    elif kind == 1:
        out = bits.signed(width, size)
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else (kind & 31) + 1
        warm = bits.signed(width, order)
        if kind < 32:
            coefficients, shift = _FIXED[order], 0
        else:
            precision = bits.take(4) + 1
            shift = int(bits.signed(5, 1)[0])
            coefficients = bits.signed(precision, order).tolist()
        out = _predicted(warm, _residual(bits, size, order), coefficients, shift)
    else:
        raise ValueError(f"subframe type {kind}")
    return out << wasted


def _predicted(warm: np.ndarray, residual: np.ndarray, coefficients, shift: int) -> np.ndarray:
    order = len(warm)
    if not order:
        return residual
    x = warm.tolist()
    turned = list(reversed(coefficients))
    for r in residual.tolist():
        x.append(r + (sum(c * v for c, v in zip(turned, x[-order:], strict=True)) >> shift))
    return np.array(x, dtype=np.int64)


def _header(bits: _Bits, stream: Stream) -> tuple[int, int, int]:
    """Samples of a frame, its channel code and width."""
    if bits.take(14) != 0x3FFE:
        raise ValueError("no frame begins here")
    bits.take(2)
    size, rate, channel, width = bits.take(4), bits.take(4), bits.take(4), bits.take(3)
    bits.take(1)
    first = bits.take(8)
    for _ in range(max(0, 8 - (first ^ 0xFF).bit_length() - 1)):
        bits.take(8)
    if size in (6, 7):
        count = bits.take(8 if size == 6 else 16) + 1
    else:
        count = 192 if size == 1 else 576 << size - 2 if 2 <= size <= 5 else 256 << size - 8
    if rate in (12, 13, 14):
        bits.take(8 if rate == 12 else 16)
    bits.take(8)
    return count, channel, _WIDTHS.get(width, stream.bits)


def frames_of(content: bytes, stream: Stream) -> Iterator[np.ndarray]:
    """(samples, channels) of whole numbers, frame by frame; a stream that is cut off ends with its last whole frame."""
    at = stream.begin
    # what a frame can need at most: samples as they are, headers, and room for codes that are longer
    most = stream.longest * stream.channels * (stream.bits + 8) // 8 + 4096
    while at < len(content):
        bits = _Bits(content[at : at + most])
        try:
            size, channel, width = _header(bits, stream)
            count = channel + 1 if channel < 8 else 2
            side = {8: 1, 9: 0, 10: 1}.get(channel)
            own = [_subframe(bits, size, width + (n == side)) for n in range(count)]
        except (EOFError, IndexError):
            return
        if channel == 8:
            own[1] = own[0] - own[1]
        elif channel == 9:
            own[0] = own[0] + own[1]
        elif channel == 10:
            mid, diff = own[0] * 2 + (own[1] & 1), own[1]
            own = [mid + diff >> 1, mid - diff >> 1]
        yield np.stack(own, axis=1)
        at += -(-bits.at // 8) + 2
