"""Ordinal quality classifier: cumulative-link regression on graded ratings.

One weight vector over hashed text features serves all grades; thresholds
t_1 < t_2 < .. order them: P(grade >= j) = sigmoid(w.x - t_j).  From these come
the expected grade and the tail probability P(grade = best) that selection uses.

Features are presences: words (runs of letters, digits and other non-ASCII
signs, A-Z lower-cased), beginnings of words of 5 to 8 bytes, which stand for
stems of languages that compound, once more for each if it occurs twice or four
times at least, runs of punctuation, and coarse levels of the shares of words in
capitals, words that repeat the one before, and punctuation.

The fit reads a bounded sample of rated rows, those of least hash of doc_id
(`max_train` at most).  Their features are counted by grade in Spark first; from these
counts, a row for each hash value, follows which features can get a weight, and
the driver then holds those of the rows alone, some dozens each however long a
text is; scoring reads every document.  The weights' size is a constant.

Defined cases: a null or empty text has no words and only the three levels; a
rated document that is missing is left out; of several ratings of a doc_id the
lowest grade counts; null ratings, and grades below 0 or not below `n_grades`,
are left out; without rated rows, with one
grade alone, or if no feature tells grades apart, every document gets the best
grade with probability 1; with few rated rows, of which few features can be told,
a document that shows none of them gets the share of the best grade, so that a
selection at MIN_TAIL takes all such documents or none; rows repeat as they came;
other columns pass through, but for those named like the two results, which are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm import _text
from nearfield.llm._io import dropped, stored

#: Values of a hashed feature.
BITS = 18
#: Rated rows in a fit, at most.
MAX_TRAIN = 6000
#: Documents whose tail probability is less are rejected.
MIN_TAIL = 0.7

#: Bytes of the beginnings of words.
BEGINNINGS = (5, 6, 7, 8)

_LETTER = np.zeros(256, dtype=bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_SMALL = np.zeros(256, dtype=bool)
_SMALL[97:123] = True
_BIG = np.zeros(256, dtype=bool)
_BIG[65:91] = True


def features(column: pa.Array) -> Iterator[np.ndarray]:
    """By row, its distinct feature numbers."""
    data, offsets = _text.utf8(column)
    low = _text._LOWER[data]
    letter, space = _LETTER[data], _text._SPACE[data]
    ws, we, wf = _text.spans(letter, offsets)
    ps, pe, pf = _text.spans(~letter & ~space, offsets)
    shift = np.uint64(64 - BITS)
    words = _text.hash_spans(low, ws, we)
    word_at, marks_at = (words >> shift).astype(np.int64), (_text.hash_spans(low, ps, pe, seed=1) >> shift).astype(np.int64)
    # a word's beginning is one masked load of eight bytes
    padded = np.concatenate([low, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray((len(low) + 1,), dtype="<u8", buffer=padded, strides=(1,))[ws]
    length = we - ws
    begins, begins_of = [], []
    for n in BEGINNINGS:
        long = np.flatnonzero(length > n)
        part = eight[long] & np.uint64((1 << (8 * n)) - 1) if n < 8 else eight[long]
        begins.append((_text.mix(part + np.uint64(n)) >> shift).astype(np.int64))
        begins_of.append(np.searchsorted(long, wf))
    small, big = (np.concatenate([[0], np.cumsum(x[data])]) for x in (_SMALL, _BIG))
    caps = (small[we] == small[ws]) & (big[we] - big[ws] >= 2)
    same = np.zeros(len(words), dtype=bool)
    same[1:] = words[1:] == words[:-1]
    for r in range(len(offsets) - 1):
        a, b, c, d = wf[r], wf[r + 1], pf[r], pf[r + 1]
        n = max(1, b - a)
        levels = (int(caps[a:b].sum() / n * 8), int(same[a + 1 : b].sum() / n * 8), min(16, int((pe[c:d] - ps[c:d]).sum() / n * 8)))
        shape = [(1 << BITS) + 32 * i + x for i, x in enumerate(levels)]
        found, count = np.unique(np.concatenate([x[y[r] : y[r + 1]] for x, y in zip(begins, begins_of, strict=True)]), return_counts=True)
        often = [(found[count >= n] * m + n) & ((1 << BITS) - 1) for n, m in ((2, 40503), (4, 60493))]
        yield np.concatenate([np.unique(np.concatenate([word_at[a:b], marks_at[c:d], found, *often])), shape])


WIDTH = (1 << BITS) + 96


@dataclass
class CumulativeLink:
    """Shared weights and ordered thresholds; grades are 0 .. len(thresholds)."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, z: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1 .. best, a row for each z."""
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.thresholds, -40, 40)))


def _negative_slopes(z: np.ndarray, t: np.ndarray, grades: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of -log P(grade) by z (a number for each row) and by the thresholds (a row for each row), where P(grade = j) = p_j - p_(j+1)."""
    p = 1 / (1 + np.exp(-np.clip(z[:, None] - t, -40, 40)))
    i = np.arange(len(z))
    hi = np.concatenate([np.ones((len(z), 1)), p], axis=1)[i, grades]
    lo = np.concatenate([p, np.zeros((len(z), 1))], axis=1)[i, grades]
    chance, dhi, dlo = np.maximum(hi - lo, 1e-12), hi * (1 - hi), lo * (1 - lo)
    gt = np.stack([((grades == j + 1) * dhi - (grades == j) * dlo) / chance for j in range(len(t))], axis=1)
    return -(dhi - dlo) / chance, gt


def telling(counts: np.ndarray, grades: np.ndarray, *, least_z: float = 3.5, least_r: float = 0.08, least_effect: float = 1.0) -> np.ndarray:
    """Which features get a weight, by how many rows of each grade have them; counts: a row for each feature; grades: rows of each grade.

    Only those that the score test against a model of thresholds alone finds far
    from chance (`least_z` standard deviations) and not too weak (a correlation of
    `least_r`, or a mean slope by occurrence of `least_effect` standard deviations,
    which a rare but pure feature has): of a hundred thousand beginnings of words
    a few hundred tell grades apart, and the others would only learn the sample by heart.
    """
    n = grades.sum()
    start = _thresholds(grades)
    null, _ = _negative_slopes(np.zeros(len(grades)), start, np.arange(len(grades)))
    mean = (null * grades).sum() / n
    df = counts.sum(axis=1)
    # the sum of a feature's slopes has, by chance, the variance of a sample without replacement
    spread = ((null - mean) ** 2 * grades).sum() / n * df * (1 - df / n) + 1e-9
    z = np.abs(counts @ (null - mean)) / np.sqrt(spread)
    # by a correlation alone a feature would need a fixed share of the rows, however many there are; its effect by occurrence doesn't depend on that
    effect = z * np.sqrt((1 - df / n) / np.maximum(df, 1))
    return (z >= least_z) & ((z >= least_r * n**0.5) | (effect >= least_effect))


def _thresholds(grades: np.ndarray) -> np.ndarray:
    """Those of a model without features."""
    share = np.clip(np.cumsum(grades[::-1])[::-1][1:] / grades.sum(), 1e-3, 1 - 1e-3)
    return -np.log(share / (1 - share))


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, *, l2: float = 0.3, steps: int = 300, rate: float = 0.05, told: np.ndarray | None = None, **gate: float) -> CumulativeLink:
    """Maximum likelihood with an L2 penalty, by full-batch Adam; the same rows give the same model.  told: by feature number, whether it gets a weight; found from the rows if it isn't given, by `gate` (see telling)."""
    if len(grades) and (grades.min() < 0 or grades.max() >= n_grades):
        raise ValueError(f"grades must lie in 0 to {n_grades - 1}")
    if not len(grades) or grades.min() == grades.max():
        return CumulativeLink(np.zeros(WIDTH), np.full(n_grades - 1, -40.0))
    by_grade = np.bincount(grades, minlength=n_grades)
    used, at = np.unique(np.concatenate(rows), return_inverse=True)
    row = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    start = _thresholds(by_grade)
    if told is None:
        counts = np.zeros((len(used), n_grades), dtype=np.int64)
        np.add.at(counts, (at, grades[row]), 1)
        told = telling(counts, by_grade, **gate)
    else:
        told = told[used.astype(np.int64)]
    if not told.any():
        return CumulativeLink(np.zeros(WIDTH), np.full(n_grades - 1, -40.0))
    keep = told[at]
    index = np.cumsum(told) - 1
    at, row, w = index[at[keep]], row[keep], np.zeros(int(told.sum()))
    first, gaps = start[0], np.log(np.maximum(np.diff(start), 1e-2))
    state = [[np.zeros_like(w), np.zeros_like(w)], [0.0, 0.0], [np.zeros_like(gaps), np.zeros_like(gaps)]]
    for step in range(1, steps + 1):
        t = np.concatenate([[first], first + np.cumsum(np.exp(gaps))])
        gz, gt = _negative_slopes(np.bincount(row, weights=w[at], minlength=len(rows)), t, grades)
        gw, gt = np.bincount(at, weights=gz[row], minlength=len(w)) + l2 * w, gt.sum(axis=0)
        ggaps = np.array([gt[j + 1 :].sum() * np.exp(gaps[j]) for j in range(len(gaps))])
        new = []
        for value, grad, (m, v), n in zip((w, first, gaps), (gw, gt.sum(), ggaps), state, range(3), strict=True):
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            state[n] = [m, v]
            new.append(value - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8))
        w, first, gaps = new
    full = np.zeros(WIDTH)
    full[used[told]] = w
    return CumulativeLink(full, np.concatenate([[first], first + np.cumsum(np.exp(gaps))]))


def fit_rated(docs: DataFrame, ratings: DataFrame, *, doc: str = "doc_id", text: str = "text", grade: str = "grade", n_grades: int, max_train: int = MAX_TRAIN) -> CumulativeLink:
    """A model of the rated documents of least hash; at most max_train of them reach the driver."""
    rated = ratings.select(ratings[doc].cast("long").alias("rid"), ratings[grade].cast("int").alias("grade")).where(f"rid is not null and grade between 0 and {n_grades - 1}")
    rated = rated.groupBy("rid").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("rid"), "rid").limit(max_train)
    own = docs.select(docs[doc].cast("long").alias("id"), docs[text].cast("string").alias("text"))
    # the rated side has max_train rows of two numbers at most
    both = own.join(F.broadcast(rated), F.col("id") == F.col("rid")).select("id", "grade", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.slices(batch, "text"):
                rows = [x.astype(np.int32).tobytes() for x in features(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("grade"), pa.array(rows, pa.binary())], ["id", "grade", "at"])

    rows = stored(both.mapInArrow(run, "id long, grade int, at binary").withColumn("digest", F.md5("at")))
    used = [rows]
    if rows.count() > max_train:
        # ids that repeat among the documents
        least = rows.select("id", "digest").orderBy(F.xxhash64("id"), "id", "digest").limit(max_train).select("id", "digest").distinct()
        rows = stored(rows.join(F.broadcast(least), ["id", "digest"]).dropDuplicates(["id", "digest"]))
        used.append(rows)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((WIDTH, n_grades), dtype=np.int64)
        for batch in batches:
            for g, at in zip(batch.column("grade").to_pylist(), batch.column("at"), strict=True):
                counts[np.frombuffer(at.as_py(), dtype=np.int32), g] += 1
        at, g = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(g.astype(np.int32)), pa.array(counts[at, g])], ["feature", "grade", "n"])

    # WIDTH rows of each grade at most, however many documents there are
    found = rows.select("grade", "at").mapInArrow(counted, "feature int, grade int, n long").groupBy("feature", "grade").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((WIDTH, n_grades), dtype=np.int64)
    counts[found.column("feature").to_numpy(), found.column("grade").to_numpy()] = found.column("n").to_numpy()
    by_grade = np.zeros(n_grades, dtype=np.int64)
    for r in rows.groupBy("grade").agg(F.count("*").alias("n")).collect():
        by_grade[r.grade] = r.n
    told = telling(counts, by_grade) if (by_grade > 0).sum() > 1 else np.zeros(WIDTH, dtype=bool)
    bits = docs.sparkSession.sparkContext.broadcast(told)

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(x.as_py(), dtype=np.int32) for x in batch.column("at")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("grade"), batch.column("digest"), pa.array([x[bits.value[x]].tobytes() for x in own], pa.binary())], ["id", "grade", "digest", "at"])

    got = rows.select("id", "grade", "digest", "at").mapInArrow(narrowed, "id long, grade int, digest string, at binary").toArrow()
    dropped(*used)
    # the sums of the fit don't depend on how rows came
    order = np.lexsort((np.array(got.column("digest").to_pylist(), dtype=str), got.column("id").to_numpy()))
    at = got.column("at").to_pylist()
    grades_ = got.column("grade").to_numpy().astype(np.int64)[order]
    return fit([np.frombuffer(at[i], dtype=np.int32) for i in order], grades_, n_grades, told=told)


def scored(df: DataFrame, model: CumulativeLink, text: str = "text", *, names: tuple[str, str] = ("expected_grade", "tail_probability")) -> DataFrame:
    """`df` with the expected grade and the probability of the best grade."""
    held = df.sparkSession.sparkContext.broadcast(model)
    count = len(df.columns)
    at = df.columns.index(text)
    inner = [f"c{i}" for i in range(count)]
    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(df.schema)) + ", expected double, tail double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for part in _text.slices(batch, inner[at]):
                z = np.array([m.weights[x].sum() for x in features(part.column(at))])
                tails = m.tails(z)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(tails.sum(axis=1)), pa.array(tails[:, -1])], [*inner, "expected", "tail"])

    out = df.toDF(*inner).mapInArrow(run, schema)
    return out.select(*(F.col(i).alias(c) for i, c in zip(inner, df.columns, strict=True) if c not in names), F.col("expected").alias(names[0]), F.col("tail").alias(names[1]))


def grades(labels: DataFrame) -> DataFrame:
    """Grades 0, 1, 2 of the labels quality and toxic: poor; sound but toxic; sound."""
    return labels.select("doc_id", (F.col("quality") * (2 - F.col("toxic"))).alias("grade"))


N_GRADES = 3
