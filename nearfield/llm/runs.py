"""Periodic runs of words: all maximal repetitions of a text, by its Lyndon arrays.

A run is a stretch of consecutive words with least period q and length >= max(12,
2 * q) that can't grow on either side and keep q.  Every run holds, for one of the
two orders of the alphabet (an order and its reverse), a Lyndon word of length q
that is the longest one at its place.  So for either order:

1. one pass from left to right keeps the places whose next smaller suffix isn't
   known yet on a stack.  Each place is compared with the stack's top; the common
   prefix of a pair that meets after a pop follows from those of its neighbours,
   or goes on where these are equal.  A comparison that begins inside the stretch
   that the farthest one has matched reads the answer of the mirrored pair, and
   reads words only beyond that stretch;
2. a pass from right to left extends the edges (place, next smaller suffix) to the
   left, reusing the stretch that reaches farthest left in the same way;
3. an edge of length q with a match of r words to the right and of l < q to the left
   is a run if l + r >= q (with l >= q the edge one period before stands for it).

Both passes compare single words only: no suffix array or tree, no hash of a
stretch.  The steps are linear in the number of words (tests count them).

Each text is one row, its words and runs are held together; texts of a batch
are worked on one after the other.

Defined cases: a null or empty text, or one of white space, has no words, no runs
and an empty rest; equal words are equal bytes (nothing is lower-cased here); a
text of fewer than 12 words has no run; repeated rows give repeated results; a null
id is kept, and its text isn't made periodic; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nearfield.llm._text import slices

#: Words of the shortest run.
LEAST = 12

Run = tuple[int, int, int]


def edges(x: list[int]) -> tuple[list[int], list[int], int]:
    """By place, its next smaller suffix and how many words the two share, and the comparisons made; x ends with a value below all others."""
    n = len(x) - 1
    nxt, right = [n] * n, [0] * n
    below, shared = [-1] * n, [0] * n
    # the match that reached farthest: x[there:end] equals x[here:end - (there - here)]
    here = there = end = 0
    steps = 0
    for j in range(1, n):
        top = j - 1
        length, grow = 0, x[top] == x[j]
        while True:
            if grow:
                known = -1
                if j + length < end:
                    gap = there - here
                    mirror, twin = j - gap, top - gap
                    if top >= there:
                        if nxt[twin] == mirror:
                            known = right[twin]
                        elif below[mirror] == twin:
                            known = shared[mirror]
                    elif below[mirror] == top:
                        known = shared[mirror]
                if known >= 0 and j + known < end:
                    length = known
                else:
                    if known >= 0:
                        length = end - j
                    begun = length
                    while x[top + length] == x[j + length]:
                        length += 1
                    steps += length - begun + 1
                    if j + length >= end:
                        here, there, end = top, j, j + length
            if x[j + length] > x[top + length]:
                below[j], shared[j] = top, length
                break
            nxt[top], right[top] = j, length
            under = below[top]
            if under < 0:
                break
            common = shared[top]
            if length > common:
                length = common
            grow = length == common and x[under + length] == x[j + length]
            top = under
    return nxt, right, steps


def of_order(x: list[int], least: int = 0) -> tuple[set[Run], int]:
    """(start, end, period) of the runs of `least` words and more whose Lyndon words are those of this order, and the comparisons made."""
    n = len(x) - 1
    nxt, right, steps = edges(x)
    left = [-1] * n
    found: set[Run] = set()
    # the match that reached farthest left: x[first:here] equals x[first + (there - here):there]
    here = there = first = n
    for i in range(n - 1, -1, -1):
        reach = right[i]
        if not reach:
            continue
        j = nxt[i]
        period = j - i
        length = 0
        if i and x[i - 1] == x[j - 1]:
            known = -1
            if i > first and j <= here:
                gap = there - here
                if nxt[i + gap] == j + gap:
                    known = left[i + gap]
            if known >= 0 and i - known >= first + (known < period):
                length = known
            else:
                if known >= 0:
                    length = i - first
                begun, most = length, min(i, period)
                while length < most and x[i - 1 - length] == x[j - 1 - length]:
                    length += 1
                steps += length - begun + 1
                if i - length <= first:
                    here, there, first = i, j, i - length
        left[i] = length
        if length < period <= length + reach and period + length + reach >= least:
            found.add((i - length, j + reach, period))
    return found, steps


def runs_of(ranks: list[int], least: int = 0) -> list[Run]:
    """(start, end, period) of all runs of `least` words and more, given the words' places in some order."""
    top = max(ranks, default=0)
    up, _ = of_order([*(r + 1 for r in ranks), 0], least)
    down, _ = of_order([*(top + 1 - r for r in ranks), 0], least)
    return sorted(up | down)


def ranked(words: list[bytes]) -> np.ndarray:
    """The words' places among the different ones in bytewise order, from 0."""
    coded = pa.array(words, pa.large_binary()).dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    place = np.empty(len(coded.dictionary), dtype=np.int64)
    place[np.array(sorted(range(len(place)), key=coded.dictionary.to_pylist().__getitem__), dtype=np.int64)] = np.arange(len(place))
    return place[coded.indices.to_numpy()]


def runs(words: list[bytes]) -> list[Run]:
    """(start, length, period) of the runs of LEAST words and more, by start, then period."""
    if len(words) < LEAST:
        return []
    return sorted(((s, e - s, p) for s, e, p in runs_of(ranked(words).tolist(), LEAST)), key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], found: list[Run]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not found:
        return words
    # places where a dropped stretch begins, less those where one ends
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def made_periodic(words: list[bytes], key: int) -> list[bytes]:
    """For one key in ten, the words with a periodic rest: a fixed rule of the key."""
    n, g = len(words), key // 10
    if key % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


#: Columns of described() besides the id.
COLUMNS = [("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]
_SCHEMA = ", ".join(f"{n} {'string' if t == pa.string() else 'long'}" for n, t in COLUMNS)


def _row(words: list[bytes]) -> tuple:
    found = runs(words)
    start, length, period = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in found).encode()
    kept = b" ".join(collapsed(words, found))
    return len(found), start, length, period, None if period is None else 1000 * length // period, hashlib.sha256(listed).hexdigest(), hashlib.sha256(kept).hexdigest()


def described(df: DataFrame, doc: str = "doc_id", text: str = "text", *, periodic: bool = False) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of every text; start to exponent_milli are of the longest run.

    periodic: texts of one id in ten are made periodic first, by the id's CRC-32.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for i, t in zip(part.column("id").to_pylist(), part.column("text"), strict=True):
                    words = (t.as_py() or "").encode().split()
                    if periodic and i is not None:
                        words = made_periodic(words, zlib.crc32(str(i).encode()))
                    out.append(_row(words))
                columns = zip(*out, strict=True) if out else [[]] * len(COLUMNS)
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(c, t) for c, (_, t) in zip(columns, COLUMNS, strict=True))], ["doc_id", *(n for n, _ in COLUMNS)])

    read = df.select(df[doc].cast("long").alias("id"), df[text].cast("string").alias("text"))
    return read.mapInArrow(rows, f"doc_id long, {_SCHEMA}")


def without_repeats(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows of `df` with `text` collapsed: the words of runs after the first period go, and the rest is joined by single spaces; texts without runs, and nulls, stay as they are."""
    names = df.columns
    inner = [f"c{i}" for i in range(len(names))]
    at = inner[names.index(text)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                out = []
                for t in part.column(at):
                    t = t.as_py()
                    words = (t or "").encode().split()
                    found = runs(words)
                    out.append(b" ".join(collapsed(words, found)).decode() if found else t)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == at else part.column(c) for c in inner], inner)

    given = df.toDF(*inner)
    given = given.withColumn(at, given[at].cast("string"))
    return given.mapInArrow(rows, given.schema).toDF(*names)
