"""A small FLAC writer for tests: every kind of subframe and stereo, with given predictors."""

import numpy as np


class Bits:
    def __init__(self):
        self.out = []

    def put(self, value, width):
        self.out += [value >> i & 1 for i in range(width - 1, -1, -1)]

    def unary(self, n):
        self.out += [0] * n + [1]

    def bytes(self):
        return np.packbits(np.array(self.out, dtype=np.uint8)).tobytes()


def residual(b, values, size, order, parts, escape):
    wide = 5 if max(map(abs, values), default=0) >= 1 << 14 else 4
    b.put(wide - 4, 2)
    b.put(parts, 4)
    at = 0
    for n in range(1 << parts):
        count = (size >> parts) - (order if n == 0 else 0)
        own = values[at : at + count]
        at += count
        if escape and n == 0:
            b.put((1 << wide) - 1, wide)
            width = max(int(abs(v)).bit_length() for v in own) + 1
            b.put(width, 5)
            for v in own:
                b.put(v & (1 << width) - 1, width)
            continue
        k = max(0, int(np.mean(np.abs(own)) + 1).bit_length() - 1)
        b.put(k, wide)
        for v in own:
            folded = 2 * v if v >= 0 else -2 * v - 1
            b.unary(folded >> k)
            b.put(folded & (1 << k) - 1, k)


FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def subframe(b, x, width, kind, escape=False, wasted=0):
    """kind: 'constant', 'verbatim', a number (fixed order), or (coefficients, shift)."""
    x = [int(v) >> wasted for v in x]
    b.put(0, 1)
    code = {"constant": 0, "verbatim": 1}.get(kind) if isinstance(kind, str) else 8 + kind if isinstance(kind, int) else 32 + len(kind[0]) - 1
    b.put(code, 6)
    b.put(1 if wasted else 0, 1)
    if wasted:
        b.unary(wasted - 1)
    width -= wasted
    put = lambda v: b.put(v & (1 << width) - 1, width)
    if kind == "constant":
        return put(x[0])
    if kind == "verbatim":
        return [put(v) for v in x] and None
    coefficients, shift = (FIXED[kind], 0) if isinstance(kind, int) else kind
    order = len(coefficients)
    for v in x[:order]:
        put(v)
    if not isinstance(kind, int):
        b.put(11, 4)
        b.put(shift, 5)
        for c in coefficients:
            b.put(c & 0xFFF, 12)
    values = [x[i] - (sum(c * x[i - j - 1] for j, c in enumerate(coefficients)) >> shift) for i in range(order, len(x))]
    residual(b, values, len(x), order, 2 if len(x) % 4 == 0 and len(x) // 4 > order else 0, escape)


def flac(blocks, rate, bits):
    """blocks: (samples (n, channels), channel code, [(kind, escape, wasted) of each subframe])."""
    longest, channels, total = max(len(x) for x, *_ in blocks), blocks[0][0].shape[1], sum(len(x) for x, *_ in blocks)
    info = longest.to_bytes(2, "big") * 2 + bytes(6) + (rate << 44 | channels - 1 << 41 | bits - 1 << 36 | total).to_bytes(8, "big") + bytes(16)
    out = b"fLaC" + bytes([0]) + (34).to_bytes(3, "big") + info + bytes([0x81]) + (5).to_bytes(3, "big") + bytes(5)
    for n, (x, channel, kinds) in enumerate(blocks):
        b = Bits()
        b.put(0x3FFE, 14)
        b.put(0, 2)
        b.put(7, 4)
        b.put(0, 4)
        b.put(channel, 4)
        b.put(0, 4)
        b.out += np.unpackbits(np.frombuffer(chr(n + 200).encode(), dtype=np.uint8)).tolist()
        b.put(len(x) - 1, 16)
        b.put(0, 8)
        left, right = x[:, 0], x[:, -1]
        own = {8: [left, left - right], 9: [left - right, right], 10: [left + right >> 1, left - right]}.get(channel, list(x.T))
        side = {8: 1, 9: 0, 10: 1}.get(channel)
        for i, (y, (kind, escape, wasted)) in enumerate(zip(own, kinds, strict=True)):
            subframe(b, y, bits + (i == side), kind, escape, wasted)
        out += b.bytes() + bytes(2)
    return out
