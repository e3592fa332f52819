"""Arrow text columns as NumPy word streams.

A word is ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, exactly what the
near-duplicate contracts ask for.  Everything works on the UTF-8 buffer of an
Arrow string column, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; bounds a worker's memory whatever the batch.
SLICE_BYTES = 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

_P1 = np.uint64(0x9E3779B97F4A7C15)
_P2 = np.uint64(0xD6E8FEB86659FD93)
_P3 = np.uint64(0xA0761D6478BD642F)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(32))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about `most` bytes of `column` (one row at least)."""
    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, before + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and row offsets of a string column; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of `inside` that don't cross row offsets: starts, ends and, by row, the first run's index."""
    n = len(inside)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes at a step."""
    size = (ends - starts).astype(np.int64)
    h = mix(size.astype(np.uint64) * _P1 + np.uint64(seed))
    if not len(starts):
        return h
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    active, at, left = slice(None), starts, size
    while True:
        chunk = eight[at].copy()
        short = np.minimum(left, 8).astype(np.uint64) * np.uint64(8)
        chunk &= np.where(short == 64, ~np.uint64(0), (np.uint64(1) << (short % np.uint64(64))) - np.uint64(1))
        h[active] = mix((h[active] ^ chunk) * _P1 + np.uint64(1))
        more = left > 8
        if not more.any():
            return h
        active = np.flatnonzero(more) if isinstance(active, slice) else active[more]
        at, left = at[more] + 8, left[more] - 8


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the rows, and by row the first word's index (one more at the end)."""
    data, offsets = utf8(column)
    data = _LOWER[data]
    starts, ends, first = spans(~_SPACE[data], offsets)
    return hash_spans(data, starts, ends), first


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """By row, the sorted distinct hashes of its k-word shingles; with fewer words, of the whole sequence; without words none."""
    hashes, first = words(column)
    n = len(hashes)
    chained = np.zeros(n, dtype=np.uint64)
    for j in range(k if n >= k else 0):
        chained[: n - k + 1] = mix(chained[: n - k + 1] * _P1 + hashes[j : n - k + 1 + j])
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(chained[a : b - k + 1])
        elif b > a:
            whole = np.array([b - a], dtype=np.uint64)
            for j in range(a, b):
                whole = mix(whole * _P1 + hashes[j])
            yield whole
        else:
            yield np.zeros(0, dtype=np.uint64)
