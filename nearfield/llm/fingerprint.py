"""Order MinHash fingerprints of whole texts.

A text's k-mers of code points are numbered by occurrence, so that repeats
count.  For each of M hash functions the L least k-mers are taken, put back in
their order of the text, and hashed as a tuple; the M values are the signature.
The share of equal values falls with the edit distance: it needs the same k-mers
in the same order, not only the same set.

The M functions are turns of one: h_i(x) = h(x) - i * 2^64 / M modulo 2^64.  Each
alone is as random as h, and the L least of all M are found in one pass, as the
successors of M points on a ring.

Neighbouring documents of one order (for edits that bring in the next text) are
found without one global sort: documents are dealt into ranges of ids, and each
range is also sent the first document of the next one.

Defined cases: a null text is empty; the signature of an empty text is all 0, so
two empty texts have likeness 1, and an empty one next to none with others;
texts shorter than k are one k-mer; equal texts have equal signatures; rows of
one doc_id are ordered by text; the only document is its own next; an empty table
gives an empty result; rows with a null id are left out; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm._io import shuffle_parts
from nearfield.llm._text import _P1, mix

#: Code points of a k-mer (a power of two), values of a signature (a power of two), k-mers of a value.
K, M, L = 16, 64, 2
#: A long text's k-mers are thinned to about this many for each point of the ring.
DENSE = 16
_OUTSIDE = np.uint32(0x110000)


def _kmers(text: str) -> np.ndarray:
    """Hashes of the text's k-mers, numbered by occurrence, in text order."""
    code = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    n = len(code)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    if n < K:
        code = np.concatenate([code, np.full(K - n, _OUTSIDE)])
        n = K
    h = mix(code.astype(np.uint64) + _P1)
    width = 1
    while width < K:
        h = mix(h[:-width] * _P1 + h[width:])
        width *= 2
    return _numbered(h)


def _numbered(h: np.ndarray) -> np.ndarray:
    """Occurrence j > 0 of a value gets another hash; only values that share a slot of a table with an earlier one are sorted."""
    n = len(h)
    size = 1 << max(4, (4 * n - 1).bit_length())
    slot = (h >> np.uint64(20)).astype(np.int64) & (size - 1)
    at = np.arange(n, dtype=np.int32)
    table = np.empty(size, dtype=np.int32)
    table[slot[::-1]] = at[::-1]
    owner = table[slot]
    later = np.flatnonzero(owner != at)
    if not len(later):
        return h
    value = h[later]
    order = np.argsort(value, kind="stable")
    ranked = value[order]
    start = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    number = np.arange(len(ranked)) - np.repeat(start, np.diff(np.r_[start, len(ranked)]))
    number = number + (h[owner[later]] == value)[order]
    out = h.copy()
    out[later[order]] = np.where(number > 0, mix(ranked + number.astype(np.uint64) * _P1), ranked)
    return out


def signature(text: str) -> np.ndarray:
    """M values of 32 bits."""
    h = _kmers(text)
    n = len(h)
    if not n:
        return np.zeros(M, dtype=np.uint32)
    step = 64 - M.bit_length() + 1
    at = None
    if n > 4 * DENSE * M:
        near = np.uint64(int(2.0**step * DENSE * M / n))
        at = np.flatnonzero((h & np.uint64((1 << step) - 1)) < near)
        if len(at) < L * M or np.bincount((h[at] >> np.uint64(step)).astype(np.int64), minlength=M).min() < L:
            at = None
    kept = h if at is None else h[at]
    order = np.argsort(kept, kind="stable")
    begin = np.searchsorted(kept[order], np.arange(M, dtype=np.uint64) << np.uint64(step))
    take = order[(begin[:, None] + np.arange(min(L, len(order)))) % len(order)]
    chosen = kept[np.sort(take, axis=1)]
    out = np.zeros(M, dtype=np.uint64)
    for j in range(chosen.shape[1]):
        out = mix(out * _P1 + chosen[:, j])
    return (out >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal values."""
    return float((a == b).mean())


def _text_of(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def fingerprints(df: DataFrame, text: str = "text", *, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows of `df` with `keep` and `fingerprint`."""
    kept = df.select(*keep).schema
    names, inner = [f.name for f in kept], [f"_k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_text_of(signature(t.as_py() or "")) for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in inner), pa.array(out, pa.string())], [*names, "fingerprint"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", fingerprint string"
    return df.select(*(df[c].alias(i) for c, i in zip(keep, inner, strict=True)), df[text].cast("string").alias("_text")).mapInArrow(run, schema)


def in_order(df: DataFrame, doc: str, text: str) -> DataFrame:
    """(bucket, ahead, id, text), sorted within partitions: each bucket is a range of ids, followed by the first rows of the next (ahead = 1; after the last the first)."""
    docs = df.select(df[doc].cast("long").alias("id"), F.coalesce(df[text].cast("string"), F.lit("")).alias("text")).where("id is not null")
    parts = shuffle_parts(df.sparkSession)
    at = [i / (4 * parts) for i in range(1, 4 * parts)]
    # as many numbers as there are ranges
    found = docs.select("id").agg(F.percentile_approx("id", at, 10_000)).first()[0]
    bounds = np.array(sorted(set(found or [])), dtype=np.int64)

    def bucket(ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(bounds, ids, side="right").astype(np.int32)

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict[int, int] = {}
        for batch in batches:
            ids = batch.column("id").to_numpy()
            b = bucket(ids)
            for x in np.unique(b).tolist():
                low[x] = min(low.get(x, 2**63 - 1), int(ids[b == x].min()))
        yield pa.RecordBatch.from_arrays([pa.array(list(low), pa.int32()), pa.array(list(low.values()), pa.int64())], ["bucket", "first"])

    firsts = sorted(tuple(r) for r in docs.select("id").mapInArrow(least, "bucket int, first long").groupBy("bucket").agg(F.min("first")).collect())
    # the first id of a bucket, and the bucket before it
    starts = np.array([f for _, f in firsts], dtype=np.int64)
    before = np.array([firsts[i - 1][0] for i in range(len(firsts))], dtype=np.int32)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(bucket(ids)), pa.array(np.zeros(len(ids), dtype=np.int32)), *batch.columns], ["bucket", "ahead", "id", "text"])
            if len(starts):
                place = np.searchsorted(starts, ids)
                first = np.flatnonzero(starts[np.minimum(place, len(starts) - 1)] == ids)
                if len(first):
                    own = batch.take(pa.array(first))
                    yield pa.RecordBatch.from_arrays([pa.array(before[place[first]]), pa.array(np.ones(len(first), dtype=np.int32)), *own.columns], ["bucket", "ahead", "id", "text"])

    dealt = docs.mapInArrow(deal, "bucket int, ahead int, id long, text string")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "ahead", "id", "text")


def edited_pairs(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document.

    The edited text is the text whose last half (rounded down) is replaced by as
    many code points, or all, of the start of the next document's text.
    """
    kinds = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]

    def row(own: tuple, nxt: tuple) -> tuple:
        i, t, sig = own
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[1][:half]
        other = signature(edited)
        return i, len(t), hashlib.sha256(edited.encode()).hexdigest(), _text_of(sig), _text_of(other), likeness(sig, other), likeness(sig, nxt[2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, own = None, None
        for batch in batches:
            out = []
            for b, ahead, i, t in zip(batch.column("bucket").to_pylist(), batch.column("ahead").to_pylist(), batch.column("id").to_pylist(), batch.column("text"), strict=True):
                if ahead and own is None:
                    continue  # a further row of the next bucket's first id
                t = t.as_py()
                new = (i, t, signature(t))
                if b == here and own is not None:
                    out.append(row(own, new))
                here, own = b, None if ahead else new
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*out, strict=True), kinds, strict=True)], [n for n, _ in kinds])

    return in_order(df, doc, text).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
