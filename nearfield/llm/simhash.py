"""SimHash near-duplicates, found by covering locality-sensitive hashing.

A text's fingerprint has a bit for each bit of its shingles' hashes: 1 if it is set
in over half of them.  Texts link when their fingerprints differ in `radius` bits
or less.

Tables: each of the 64 bits is given a nonzero vector of radius + 1 bits; the mask
of a nonzero vector v keeps the bits whose vectors have an odd inner product with v.
The vectors of any `radius` bits leave some v orthogonal to all of them, so that two
fingerprints which differ in those bits only agree under the mask of v: every pair
within the radius falls in one bucket of some of the 2^(radius + 1) - 1 tables.

Only different fingerprints go into the tables.  A bucket of SMALL fingerprints or
less is compared whole, in a task.  Of a larger one only neighbours in order are
compared at first, which joins most of a group of near copies; if it still holds
several components, its members go into a second set of tables, with other masks,
inside that bucket, and so on: each level fixes about half of the bits that are still
free, so that buckets shrink, and the masks cover every pair again.  So no bucket is
gathered beyond SMALL, and no pair is lost.  Links leave tasks as spanning stars,
and become components.

Defined cases: a null or empty text, or one of white space, has fingerprint 0 and
links like any other; fewer words than a shingle make one shingle of the whole
sequence; a bit set in exactly half of the hashes is 0; a repeated doc_id is one
document, linked by each of its texts; a null doc_id is dropped; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm._components import components, contracted
from nearfield.llm._io import dropped, stored
from nearfield.llm._text import slices

#: Fingerprints of a bucket that one task compares whole; neighbours compared in a larger one.
SMALL, LOOK = 1024, 8
#: Hashes whose bits are counted at once.
_CHUNK = 1 << 16
_SEED = 42


def fingerprint(text: str, k: int) -> int:
    """The SimHash of the k-word shingles, repeats included, as an unsigned number."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return 0
    joined, size = b" ".join(words), len(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    # the place after each word and its space, so also where the next one begins
    begins = [0, *ends[:-1]]
    last = min(k, size) - 1
    of = xxhash.xxh64_intdigest
    total = size - last
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, total, _CHUNK):
        to = min(at + _CHUNK, total)
        h = np.array([of(joined[a : b - 1], _SEED) for a, b in zip(begins[at:to], ends[at + last : to + last], strict=True)], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((2 * ones > total).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def masks(radius: int, seed: int = 0) -> list[int]:
    """The covering masks: unsigned numbers of 64 bits, 2^(radius + 1) - 1 of them."""
    top = 1 << (radius + 1)
    vector = np.random.default_rng(seed).permutation(np.arange(64) % (top - 1) + 1)
    odd = np.bitwise_count(vector[None, :] & np.arange(1, top)[:, None]) & 1
    return [int(sum(1 << b for b in np.flatnonzero(row).tolist())) for row in odd]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(df: DataFrame, doc: str = "doc_id", text: str = "text", *, k: int = 4) -> DataFrame:
    """(doc, print) of every row with an id; print as a signed long."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = np.array([fingerprint(t.as_py() or "", k) for t in part.column("text")], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(found.view(np.int64))], ["doc", "print"])

    read = df.select(df[doc].cast("long").alias("doc"), df[text].cast("string").alias("text")).where("doc is not null")
    return read.mapInArrow(rows, "doc long, print long")


def _near(bucket: np.ndarray, prints: np.ndarray, node: np.ndarray, comp: np.ndarray, radius: int, most: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of the links between rows of one bucket, each with the next `most` ones (None: all); rows stand in order of their buckets."""
    left, right, at, step = [], [], np.arange(len(bucket)), 1
    while len(at) and (most is None or step <= most):
        at = at[at + step < len(bucket)]
        at = at[bucket[at] == bucket[at + step]]
        hit = at[(np.bitwise_count(prints[at] ^ prints[at + step]) <= radius) & (comp[at] != comp[at + step])]
        left.append(node[hit])
        right.append(node[hit + step])
        step += 1
    none = np.zeros(0, np.int64)
    a, b = np.concatenate([none, *left]), np.concatenate([none, *right])
    return contracted(a, b) if len(a) else (a, b)


def _links(rows: DataFrame, radius: int, most: int | None) -> DataFrame:
    """(u, v): links inside buckets of sorted rows (mask, key, print, node, comp), as stars.  With `most` unset buckets are whole in a partition and of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(cols: list[np.ndarray]) -> pa.RecordBatch:
            mask, key, prints, node, comp = cols
            new = np.r_[False, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])]
            u, v = _near(np.cumsum(new), prints.view(np.uint64), node, comp, radius, most)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        held: list[np.ndarray] | None = None
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            if held is not None:
                cols = [np.concatenate([a, b]) for a, b in zip(held, cols, strict=True)]
            if not len(cols[0]):
                continue
            if most is None:
                # the last bucket may go on
                same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
                cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            else:
                cut = max(0, len(cols[0]) - most)
            held = [c[cut:].copy() for c in cols]
            ready = cols if most is not None else [c[:cut] for c in cols]
            if len(ready[0]):
                yield out(ready)
        if held is not None and most is None and len(held[0]):
            yield out(held)

    return rows.select("mask", "key", "print", "node", "comp").mapInArrow(run, "u long, v long")


def _buckets(rows: DataFrame, radius: int, level: int) -> DataFrame:
    """Rows (mask, print, node, comp) in the buckets of a level's tables, inside the one that `mask` fixes."""
    table = F.explode(F.array(*(F.lit(_signed(m)) for m in masks(radius, level))))
    inside = rows.select(F.col("mask").alias("outer"), "print", "node", "comp", table.alias("own"))
    inside = inside.select((F.col("outer").bitwiseOR(F.col("own"))).alias("mask"), "print", "node", "comp")
    return inside.select("mask", F.col("mask").bitwiseAND(F.col("print")).alias("key"), "print", "node", "comp")


def near_duplicates(df: DataFrame, doc: str = "doc_id", text: str = "text", *, k: int = 4, radius: int = 4, small: int = SMALL) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document; component_id is the least doc_id reachable by links.

    fingerprint: 16 hexadecimal digits.  small: fingerprints of a bucket that one task compares whole.
    """
    if not 0 <= radius < 16:
        raise ValueError("radius must lie in 0 to 15")
    docs = stored(fingerprints(df, doc, text, k=k))
    prints = stored(docs.groupBy("print").agg(F.min("doc").alias("node")))
    # a document of several texts ties their fingerprints
    several = docs.groupBy("doc").agg(F.min("print").alias("lo"), F.max("print").alias("hi")).where("lo <> hi").select("doc")
    ties = docs.join(several, "doc", "left_semi").join(prints, "print").select(F.col("node").alias("u"), F.col("doc").alias("v")).distinct()
    joined = components(ties)
    used = [docs, prints, joined]
    rows, level = prints.select(F.lit(0).cast("long").alias("mask"), "print", "node", F.col("node").alias("comp")), 0
    while True:
        buckets = _buckets(rows, radius, level)
        sizes = stored(buckets.groupBy("mask", "key").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("mask", "key", "n"))
        whole = buckets.join(sizes.where(F.col("n") <= small).select("mask", "key"), ["mask", "key"])
        links = _links(whole.repartition("mask", "key").sortWithinPartitions("mask", "key", "print"), radius, None)
        large = stored(buckets.join(sizes.where(F.col("n") > small).select("mask", "key"), ["mask", "key"]))
        ranged = large.repartitionByRange("mask", "key", "print").sortWithinPartitions("mask", "key", "print")
        edges = stored(links.unionByName(_links(ranged, radius, LOOK)).unionByName(joined.select(F.col("node").alias("u"), F.col("component").alias("v"))))
        joined = components(edges)
        used += [sizes, large, edges, joined]
        if not large.limit(1).count():
            break
        of = joined.withColumnRenamed("component", "named")
        named = large.drop("comp").join(of, "node", "left").select("mask", "key", "print", "node", F.coalesce("named", "node").alias("comp"))
        open_ = named.groupBy("mask", "key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("mask", "key")
        rows, level = stored(named.join(open_, ["mask", "key"]).select("mask", "print", "node", "comp")), level + 1
        used.append(rows)
    of = prints.join(joined, "node", "left").select("print", F.coalesce("component", "node").alias("component_id"))
    digits = F.lower(F.lpad(F.hex("print"), 16, "0"))
    out = stored(docs.join(of, "print").select(F.col("doc").alias("doc_id"), digits.alias("fingerprint"), "component_id"))
    dropped(*used)
    return out
