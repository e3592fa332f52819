"""Exact top-k search by inner product, with block-at-a-time pruning.

Vectors become whole numbers.  Candidates are dealt into groups; in a group they
are numbered anew, like ones next to each other, and cut into ranges, the
blocks.  A block keeps a forward index (its vectors) and, by dimension, its
largest and smallest component: the maxima of the terms "+d" and "-d".  For a
query the sum of q_d times the maximum (or the minimum, if q_d < 0) bounds every
score of the block.  Blocks are visited in falling order of that bound, in steps
that double, and a query stops when its next bound is below its k-th score (an
equal one goes on, since a tie goes to the smaller id); within a step, too, only
blocks are scored whose bound reaches the k-th score so far.

Groups and chunks of queries meet pairwise in tasks of bounded size (fewer rows
of wider vectors); each pair returns k rows a query at most, and these are
merged.  Nothing is broadcast or collected.

Scores are exact for every finite vector.  Where the largest components of two
blocks and their width show that each sum stays below 2^53, one product of
doubles is exact.  Else components are cut into digits so short that the products
of two digits are, and these are added as longs, or as Python integers where a
sum may leave a long.  Bounds of blocks, which are rounded then, are widened by
more than their error.

Defined cases: vectors that are null, or hold a null or a non-finite component,
take no part; shorter vectors count as filled up with 0; of the rows that repeat
an id the least vector counts; a null id is dropped; a query's own id is no
candidate; fewer candidates than k give fewer rows; an empty table gives no
rows; a score that leaves the longs counts as the nearest long, and a scaled
component beyond the doubles as the nearest double.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm._io import stored

#: Candidates in a group, queries in a chunk: what one task holds, of vectors of up to WIDE numbers; of wider ones less.
GROUP, CHUNK, WIDE = 16384, 4096, 256
#: Candidates in a block.
BLOCK = 64
#: Random directions whose signs number like vectors next to each other.
DIRECTIONS = 12

_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Lists of doubles as rows, filled up with 0."""
    lists = vectors.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0)
    size = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    width = int(size.max(initial=0))
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width))
    out[np.arange(width) < size[:, None]] = flat
    return out


def _digits(x: np.ndarray, bits: int) -> list[tuple[int, np.ndarray]]:
    """Whole doubles as sums of digit * 2^exponent with |digit| < 2^bits; digits that are 0 throughout are left out."""
    out, exponent = [], 0
    while x.any():
        high = np.trunc(np.ldexp(x, -bits))
        low = x - np.ldexp(high, bits)
        if low.any():
            out.append((exponent, low))
        x, exponent = high, exponent + bits
    return out


def _largest(x: np.ndarray) -> np.ndarray:
    """By row, its largest component without sign."""
    return np.abs(x).max(axis=1, initial=0.0)


def products(q: np.ndarray, x: np.ndarray, most_q: float, most_x: float) -> np.ndarray:
    """Inner products of the rows of two matrices of whole doubles, none above these, as the nearest longs."""
    top = int(most_q) * int(most_x) * max(1, x.shape[1])
    if top < 1 << 53:
        return (q @ x.T).astype(np.int64)
    bits = (53 - max(1, x.shape[1]).bit_length()) // 2
    whole = np.int64 if top < 1 << 63 else object
    out = np.zeros((len(q), len(x)), dtype=whole)
    ours, theirs = _digits(q, bits), _digits(x, bits)
    for a, left in ours:
        for b, right in theirs:
            out = out + (left @ right.T).astype(np.int64).astype(whole) * (1 << (a + b))
    return out if whole is np.int64 else np.clip(out, _LEAST, _MOST).astype(np.int64)


def _widened(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))


def _reordered(x: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """An order of the rows in which like ones stand together; ids break ties."""
    if not x.shape[1]:
        return np.argsort(ids, kind="stable")
    planes = np.random.default_rng(11).standard_normal((x.shape[1], DIRECTIONS))
    bits = (x @ planes > 0).astype(np.int64)
    # Gray order: neighbours differ in one sign
    gray = np.bitwise_xor.accumulate(bits, axis=1)
    return np.lexsort((ids, gray @ (1 << np.arange(DIRECTIONS)[::-1])))


class Blocks:
    """Forward indexes and term maxima of a group of candidates."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, block: int = BLOCK) -> None:
        x = x.astype(np.float64)
        order = _reordered(x, ids)
        self.ids, self.x, self.block = ids[order], x[order], block
        cuts = np.arange(0, len(ids), block)
        self.cuts = np.append(cuts, len(ids))
        self.most = np.maximum.reduceat(self.x, cuts, axis=0) if x.shape[1] else np.zeros((len(cuts), 0))
        self.least = np.minimum.reduceat(self.x, cuts, axis=0) if x.shape[1] else np.zeros((len(cuts), 0))
        self.top_of = np.maximum.reduceat(_largest(self.x), cuts)
        self.scored = 0

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """By query and block, no less than any score."""
        with np.errstate(over="ignore", invalid="ignore"):
            out = np.maximum(q, 0) @ self.most.T + np.minimum(q, 0) @ self.least.T
            terms = np.abs(q) @ np.maximum(np.abs(self.most), np.abs(self.least)).T
            exact = terms < 2.0**53
            out = np.where(exact, out, out + terms * (4 + q.shape[1]) * 2.0**-51)
        return np.where(np.isnan(out), np.inf, out)

    def top(self, qids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, candidate, score) of the k best of each query."""
        q = q.astype(np.float64)
        bound, most = self.bounds(q), _largest(q)
        order = np.argsort(-bound, axis=1, kind="stable")
        bound = np.take_along_axis(bound, order, axis=1)
        score, best = np.full((len(q), k), _LEAST), np.full((len(q), k), _MOST)
        # candidates seen, and the k-th score as a double no larger (none: minus infinity)
        seen, kth = np.zeros(len(q), dtype=np.int64), np.full(len(q), -np.inf)
        at, width = 0, 1
        while at < order.shape[1]:
            live = np.flatnonzero(bound[:, at] >= kth)
            if not len(live):
                break
            # the next blocks of every query, block by block; twice as many each time, so that at most half of the visits are in vain
            visit, due = order[live, at : at + width], bound[live, at : at + width]
            query, limit, visit = np.repeat(live, visit.shape[1]), due.ravel(), visit.ravel()
            at, width = at + width, width * 2
            by = np.argsort(visit, kind="stable")
            starts = np.flatnonzero(np.r_[True, visit[by][1:] != visit[by][:-1]])
            for a, b in zip(starts, np.r_[starts[1:], len(by)], strict=True):
                own_ = by[a:b]
                own_ = own_[limit[own_] >= kth[query[own_]]]
                if not len(own_):
                    continue
                rows, n = query[own_], visit[own_[0]]
                part = slice(self.cuts[n], self.cuts[n + 1])
                got = products(q[rows], self.x[part], most[rows].max(), self.top_of[n])
                own = np.broadcast_to(self.ids[part], got.shape)
                self.scored += got.size
                itself = own == qids[rows][:, None]
                if itself.any():
                    got, own = np.where(itself, _LEAST, got), np.where(itself, _MOST, own)
                seen[rows] += own.shape[1] - itself.sum(axis=1)
                s, i = np.concatenate([score[rows], got], axis=1), np.concatenate([best[rows], own], axis=1)
                keep = np.lexsort((i, ~s), axis=1)[:, :k]
                score[rows], best[rows] = np.take_along_axis(s, keep, axis=1), np.take_along_axis(i, keep, axis=1)
                low = score[rows, -1].astype(np.float64)
                low = np.where(np.abs(low) < 2.0**53, low, np.nextafter(low, -np.inf))
                kth[rows] = np.where(seen[rows] >= k, low, -np.inf)
        found = np.arange(k) < seen[:, None]
        at = np.nonzero(found)[0]
        return qids[at], best[found], score[found]


def whole_numbers(df: DataFrame, vec: str, embedding: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * x), as whole doubles, of the vectors that take part, once by id."""
    x = df[embedding].cast("array<double>")
    sound = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    largest = F.lit(float(np.finfo(np.float64).max))

    def floored(c: Column) -> Column:
        y = F.least(F.greatest(c * F.lit(float(scale)), -largest), largest)
        # a double of 2^53 and more is whole
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)

    rows = df.select(df[vec].cast("long").alias("id"), F.when(sound, F.transform(x, floored)).alias("v")).where("id is not null and v is not null")
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def search(df: DataFrame, is_query: Column, vec: str = "vec_id", embedding: str = "embedding", *, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query, ties to the smaller id.

    is_query: a condition on the column `id`.
    """
    rows = stored(whole_numbers(df, vec, embedding, scale))
    count, asked, width = rows.agg(F.count("*"), F.count(F.when(is_query, 1)), F.max(F.size("v"))).first()
    wide = max(1, -(-(width or 0) // WIDE))
    groups, chunks = max(1, -(-count * wide // GROUP)), max(1, -(-asked * wide // CHUNK))
    candidates = rows.select(F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("c"), "id", "v")
    queries = rows.where(is_query).select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(chunks)).cast("int").alias("c"), "id", "v")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        x, q = _matrix(left.column("v")), _matrix(right.column("v"))
        width = max(x.shape[1], q.shape[1])
        found = Blocks(left.column("id").to_numpy(), _widened(x, width)).top(right.column("id").to_numpy(), _widened(q, width), k)
        return pa.Table.from_arrays([pa.array(a, pa.int64()) for a in found], schema=schema)

    met = candidates.groupBy("g", "c").cogroup(queries.groupBy("g", "c")).applyInArrow(meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
