"""Deleting later copies of repeated line runs, by a suffix array over line ids.

The corpus is one sequence of lines by (doc_id, text, line).  A *run* of lines
of one document counts if it holds `min_words` words at least.  A line goes if
it lies in such a run that also begins at an earlier place; what is decided is
decided on the texts as they came, so the first copy of every line stays.

*Suffix array.*  Suffixes are sorted by prefix doubling, spread over the cluster:
round k gives each suffix its rank among all suffixes by their first 2^k lines,
from the ranks of round k-1 at its own place and 2^(k-1) lines on.  A rank is
(line id, offset in the order of the suffixes that begin with this line), so a
round only sorts within groups that are still tied, on counts that are aggregated
before; suffixes whose first 2^k lines occur nowhere else are left out from then
on, and with them all unique lines at once.  Those left are in the order of the
suffix array.

*Intervals of longest common prefixes.*  Suffixes that share their first L lines
stand next to each other in the array: an interval of common prefixes >= L.  With
2^k <= L < 2^(k+1) all of them, and no other, have the same two ranks of round k:
at their own place and at L - 2^k lines on.  So intervals are read off from the
ranks of one round, whatever L, with their size and their earliest suffix.

*Maximal runs.*  The shortest counted runs from each line on and back to each
line tell all: a maximal repeated run that counts is the union of those in it, as
any line of it begins or ends one of them.  Each looks its interval up; those
whose interval begins earlier are later copies, and those of a document that
overlap are joined to maximal runs, which are deleted.  Doubling ends with the
longest of the shortest runs, since longer common prefixes decide nothing.

One line, or one run, may make up a third of the corpus: keys that hold more
than a HOT-th of the rows are found by their counts, are HOT at most, and meet
their tables by broadcast; so no task gathers their rows.

Defined cases: a null text stays null; rows with a null doc_id have no place in
the order, so they pass through as they are and make nothing else a copy; lines
end at "\\n" only; empty lines are lines without words; rows equal in doc_id and
text are one document and share its result; rows of one doc_id with other texts
are documents of their own, ordered by a hash of the text; an empty table stays
empty; all other columns pass through untouched, whatever their names, but for
those named like a count that is asked for, which the count replaces.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm import _text
from nearfield.llm._io import dropped, stored

#: A run of fewer words is left alone.
MIN_WORDS = 50
#: Keys with more than a HOT-th of all rows are joined by broadcast: HOT of them at most.
HOT = 4096
_RANK = ["h", "g", "o"]
_PLACE = ["doc", "th", "line"]


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """By line: its id (two longs), and the lengths of the shortest runs that count from it on and back (0: none)."""

    def reach(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        upto = np.concatenate([[0], np.cumsum(words)])
        at = np.arange(len(words))
        end = np.searchsorted(upto, upto[:-1] + min_words, side="left")
        start = np.searchsorted(upto, upto[1:] - min_words, side="right") - 1
        return np.where(end <= len(words), end - at, 0), np.where(start >= 0, at + 1 - start, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for part in _text.slices(batch, "text"):
                docs_, ths, counts, hs, gs, on, back = [], [], [], [], [], [], []
                for doc, th, text in zip(part.column("doc").to_pylist(), part.column("th").to_pylist(), part.column("text").to_pylist(), strict=True):
                    lines = text.encode().split(b"\n")
                    ids = [xxhash.xxh3_128_intdigest(x) for x in lines]
                    hs += [(x & (2**64 - 1)) - 2**63 for x in ids]
                    gs += [(x >> 64) - 2**63 for x in ids]
                    a, b = reach(np.array([len(x.split()) for x in lines]))
                    on.append(a)
                    back.append(b)
                    docs_.append(doc)
                    ths.append(th)
                    counts.append(len(lines))
                if docs_:
                    line = np.concatenate([np.arange(n) for n in counts])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(docs_, counts), pa.int64()), pa.array(np.repeat(ths, counts), pa.int64()), pa.array(line, pa.int32()), pa.array(hs, pa.int64()), pa.array(gs, pa.int64()), pa.array(np.concatenate(on), pa.int32()), pa.array(np.concatenate(back), pa.int32())],
                        ["doc", "th", "line", "h", "g", "on", "back"],
                    )

    return docs.mapInArrow(run, "doc long, th long, line int, h long, g long, on int, back int")


def _looked_up(rows: DataFrame, keyed: DataFrame, keys: list[str], count: str) -> DataFrame:
    """rows joined to `keyed`, a stored table with one row for each key and `count`, how many of the rows it has."""
    total = keyed.agg(F.sum(count)).first()[0] or 0
    hot = keyed.where(F.col(count) > total / HOT)
    if not hot.limit(1).count():
        return rows.join(keyed.drop(count), keys)
    # fewer than HOT keys hold more than a HOT-th each
    hot = F.broadcast(hot.drop(count))
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(hot, keys).unionByName(cold.join(keyed.where(F.col(count) <= total / HOT).drop(count), keys))


def _less(counts: DataFrame) -> DataFrame:
    """counts with `less`: rows of the same rank with a smaller continuation. Sums go over parts of the order first, so that the many continuations of one line are dealt over tasks."""
    upto = lambda by, order: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("p1", F.shiftright("h2", 52)).withColumn("p2", F.shiftright("o2", 12))
    by1, by2 = [*_RANK, "p1"], [*_RANK, "p1", "h2", "g2", "p2"]
    whole = counts.groupBy(*by2).agg(F.sum("c").alias("c2"))
    first = whole.groupBy(*by1).agg(F.sum("c2").alias("c1")).select(*by1, F.coalesce(F.sum("c1").over(upto(_RANK, ["p1"])), F.lit(0)).alias("l1"))
    second = whole.select(*by2, F.coalesce(F.sum("c2").over(upto(by1, ["h2", "g2", "p2"])), F.lit(0)).alias("l2"))
    third = counts.withColumn("l3", F.coalesce(F.sum("c").over(upto(by2, ["o2"])), F.lit(0)))
    return third.join(second, by2).join(first, by1).select(*_RANK, "h2", "g2", "o2", "c", (F.col("l1") + F.col("l2") + F.col("l3")).alias("less"))


def _doubled(ranks: DataFrame, step: int) -> DataFrame:
    """The ranks by twice `step` lines, of those suffixes that still share them with another."""
    after = ranks.select("doc", "th", (F.col("line") - step).alias("line"), *(F.col(c).alias(f"{c}2") for c in _RANK))
    pairs = stored(ranks.join(after, _PLACE))
    keys = [*_RANK, *(f"{c}2" for c in _RANK)]
    counts = stored(_less(stored(pairs.groupBy(*keys).agg(F.count("*").alias("c")).where("c > 1"))))
    out = stored(_looked_up(pairs, counts, keys, "c").select(*_PLACE, "h", "g", (F.col("o") + F.col("less")).alias("o")))
    dropped(pairs, counts)
    return out


def suffix_ranks(lines: DataFrame, rounds: int) -> list[DataFrame]:
    """Round by round, (doc, th, line, h, g, o) of suffixes whose first 1, 2, 4 .. lines occur elsewhere too; (h, g, o) orders them as a suffix array does."""
    again = stored(lines.groupBy("h", "g").agg(F.count("*").alias("c")).where("c > 1"))
    out = [stored(_looked_up(lines.select(*_PLACE, "h", "g"), again, ["h", "g"], "c").select(*_PLACE, "h", "g", F.lit(0).cast("long").alias("o")))]
    dropped(again)
    for k in range(rounds):
        out.append(_doubled(out[-1], 1 << k))
    return out


_INTERVAL = ["length", *_RANK, *(f"{c}2" for c in _RANK)]


def in_intervals(runs: DataFrame, ranks: list[DataFrame]) -> DataFrame:
    """runs (doc, th, start, length) with the name of their interval of common prefixes >= length; those without a second copy are left out."""
    found = None
    for k, rank in enumerate(ranks):
        own = runs.where(F.col("length").between(1 << k, (2 << k) - 1))
        head = rank.select("doc", "th", F.col("line").alias("start"), *_RANK)
        tail = rank.select("doc", "th", F.col("line").alias("last"), *(F.col(c).alias(f"{c}2") for c in _RANK))
        own = own.join(head, ["doc", "th", "start"]).withColumn("last", F.col("start") + F.col("length") - (1 << k)).join(tail, ["doc", "th", "last"]).drop("last")
        found = own if found is None else found.unionByName(own)
    return found


def maximal(runs: DataFrame) -> DataFrame:
    """runs (doc, th, start, length) with overlapping ones of a document joined."""
    by = Window.partitionBy("doc", "th").orderBy("start", "length")
    end = F.col("start") + F.col("length")
    before = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(before >= F.col("start"), 0).otherwise(1)
    numbered = runs.withColumn("begins", begins).withColumn("nth", F.sum("begins").over(by))
    return numbered.groupBy("doc", "th", "nth").agg(F.min("start").alias("start"), (F.max(end) - F.min("start")).alias("length")).drop("nth")


def later_copies(df: DataFrame, doc: str = "doc_id", text: str = "text", *, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, th, start, length): maximal runs of lines that lie in runs that begin at an earlier place too; th is xxhash64 of the text."""
    docs = df.select(df[doc].cast("long").alias("doc"), F.xxhash64(df[text]).alias("th"), df[text].alias("text")).where("text is not null and doc is not null")
    lines = stored(_lines(docs, min_words).dropDuplicates(_PLACE))
    on = F.struct(F.col("line").alias("start"), F.col("on").alias("length"))
    back = F.struct((F.col("line") - F.col("back") + 1).alias("start"), F.col("back").alias("length"))
    ranks = suffix_ranks(lines, 0)
    runs = lines.join(ranks[0].select(*_PLACE), _PLACE, "left_semi").select("doc", "th", F.explode(F.array(on, back)).alias("run")).select("doc", "th", "run.*").where("length > 0").distinct()
    runs = stored(runs)
    longest = runs.agg(F.max("length")).first()[0] or 1
    for k in range(int(math.log2(longest))):
        ranks.append(_doubled(ranks[-1], 1 << k))
    found = stored(in_intervals(runs, ranks))
    place = F.struct("doc", "th", "start")
    intervals = stored(found.groupBy(*_INTERVAL).agg(F.min(place).alias("earliest"), F.count("*").alias("size")).where("size > 1"))
    later = _looked_up(found, intervals, _INTERVAL, "size").where(place != F.col("earliest")).select("doc", "th", "start", "length")
    out = stored(maximal(later))
    dropped(lines, runs, found, intervals, *ranks)
    return out


def without_later_copies(df: DataFrame, doc: str = "doc_id", text: str = "text", *, min_words: int = MIN_WORDS, counts: bool = False, drop_emptied: bool = False) -> DataFrame:
    """`df` with later copies of repeated line runs deleted from `text`.

    counts: two more columns, n_lines and n_removed (0 for a null text), in place of any of these names.
    drop_emptied: rows go whose lines have all been deleted.
    """
    runs = later_copies(df, doc, text, min_words=min_words)
    marks = runs.groupBy("doc", "th").agg(F.collect_list(F.struct("start", "length")).alias("runs")).select(F.col("doc").alias("_doc"), F.col("th").alias("_th"), F.col("runs").alias("_runs"))
    names = df.columns
    at = names.index(text)
    whole = df.toDF(*(f"c{i}" for i in range(len(names))))
    key = f"c{names.index(doc)}"
    whole = whole.withColumn("_h", F.xxhash64(f"c{at}"))
    both = whole.join(marks.hint("merge"), (whole[key].cast("long") == marks["_doc"]) & (whole["_h"] == marks["_th"]), "left").drop("_doc", "_th", "_h")
    kinds = [f.dataType.simpleString() for f in df.schema]
    schema = ", ".join(f"c{i} {t}" for i, t in enumerate(kinds)) + ", n_lines int, n_removed int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.slices(batch, f"c{at}"):
                marked = part.column("_runs").to_pylist()
                texts, total, gone = [], [], []
                for value, own in zip(part.column(f"c{at}"), marked, strict=True):
                    if own is None:
                        total.append(0 if not value.is_valid else value.as_py().count("\n") + 1)
                        gone.append(0)
                        texts.append(value.as_py())
                        continue
                    lines = value.as_py().split("\n")
                    cut = np.zeros(len(lines) + 1, dtype=np.int64)
                    np.add.at(cut, [r["start"] for r in own], 1)
                    np.add.at(cut, [r["start"] + r["length"] for r in own], -1)
                    stay = np.cumsum(cut)[:-1] == 0
                    total.append(len(lines))
                    gone.append(int(len(lines) - stay.sum()))
                    texts.append("\n".join(x for x, s in zip(lines, stay, strict=True) if s))
                cols = [part.column(f"c{i}") for i in range(len(kinds))]
                cols[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*cols, pa.array(total, pa.int32()), pa.array(gone, pa.int32())], [*(f"c{i}" for i in range(len(kinds))), "n_lines", "n_removed"])

    out = both.mapInArrow(run, schema)
    if drop_emptied:
        out = out.where("n_removed = 0 or n_removed < n_lines")
    added = ["n_lines", "n_removed"] * counts
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names) if c not in added), *added)
