"""Near-duplicate groups by an exact n-gram Jaccard join with rare-first prefixes.

Two texts link when ``100 * |A & B| >= percent * |A | B|`` over their sets of
k-word shingles (64-bit hashes).  The join works on distinct sets only:

1. a fixed-size table of counts over all shingles of all texts puts shingles in
   one total order, rare ones first (any total order is exact; a rare-first one
   is quick);
2. each set posts the shingles of its prefix, ``n - ceil(percent * n) + 1`` of
   them, and shingles that one set alone posts are dropped;
3. first round: neighbours by size in each posting list are candidates if the
   length and positional filters pass; each pair is verified once, and links are
   contracted to components;
4. further rounds: candidate pairs of the posting lists that lie in different
   components, in blocks of bounded size, with the length and positional filters
   and a suffix filter, which compares how two sets fall into fixed ranges: as
   many ranges as hold an odd number of one set and an even one of the other, so
   many shingles differ at least (128 ranges in the lists, 1024 for each pair).  The second round
   takes one of them for each posting, at random, which joins most of a group of
   near copies; the third takes all that are left.  A group that is joined makes no
   more pairs, so its cost is about linear in its size, and no pair that could
   still join two components is left out.

Nothing is collected but the count table, whose size is a constant, a filter of
needed documents, likewise, and those 64-bit names of sets that two sets have
(their 128 bits differ; some n^2 / 2^65 of n sets): such sets get other names
before anything is joined by them.

Defined cases: a null or empty text, or one of white space, has an empty set and
is linked with nothing; fewer than k words make one shingle of the whole
sequence; equal sets always link; a repeated doc_id is one document, linked by
each of its texts, and has a row for each row, with one component; a null doc_id
is dropped; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm import _text
from nearfield.llm._components import components
from nearfield.llm._io import dropped, shuffle_parts, stored

#: Bits of a shingle's hash that choose its counter: the count table has 4 MB whatever the corpus.
COUNT_BITS = 20
#: Rows of the count table in one piece of the sum.
PIECE = 1 << 14
#: Ranges of the suffix filter that reads a pair before its sets are.
FINE = 1024
#: Bits of the filter of needed documents: 4 MB.
FILTER_BITS = 25
#: Postings in one block of a long posting list.
BLOCK = 2048
_LOW = np.uint64((1 << (64 - COUNT_BITS)) - 1)
_SHIFT = np.uint64(64 - COUNT_BITS)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[int, np.ndarray]]:
    for batch in batches:
        for part in _text.slices(batch, "text"):
            yield from zip(part.column("id").to_pylist(), _text.shingle_sets(part.column("text"), k), strict=True)


def _class_of(s: np.ndarray, bits: int) -> tuple[int, int]:
    """128 bits that stand for a set, as two longs; of the first only `bits` count."""
    import xxhash

    h = xxhash.xxh3_128_intdigest(s.tobytes())
    return ((h & (2**64 - 1)) >> (64 - bits)) - 2**63, (h >> 64) - 2**63


def _name_of(s: np.ndarray, bits: int, shared: frozenset[int]) -> int:
    """The long that names a set; `shared`: those that more than one set would have."""
    first, second = _class_of(s, bits)
    return second if first in shared else first


_COUNTED = ["piece", "part", "counts"]
_PROFILE = ["doc", "n", "class", "class2", "odd1", "odd2", "odd"]


def _profiles(docs: DataFrame, k: int, bits: int) -> DataFrame:
    """By document: its set's size, the set's class (two longs), and the parities of its counts in 128 fixed ranges (two longs) and in FINE ones (binary).

    Each task adds its count table in rows of their own: how often each value of
    a hash's top bits occurs, in pieces; `part` spreads the tasks over the sums.
    """
    kinds = {"odd": pa.binary(), "counts": pa.binary(), "piece": pa.int32(), "part": pa.int32()}
    schema = pa.schema([(c, kinds.get(c, pa.int64())) for c in [*_PROFILE, *_COUNTED]])
    parts = shuffle_parts(docs.sparkSession)

    def rows_of(names: list[str], rows: list[tuple]) -> pa.RecordBatch:
        given = dict(zip(names, zip(*rows, strict=True), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(given[f.name], f.type) if f.name in given else pa.nulls(len(rows), f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << COUNT_BITS, dtype=np.int64)
        task = TaskContext.get().partitionId()
        for batch in batches:
            rows: list[tuple] = []
            waiting = []
            for i, s in _sets(iter([batch]), k):
                odd = (np.bincount((s >> np.uint64(54)).astype(np.int64), minlength=FINE) & 1).astype(np.uint8)
                few = np.packbits(odd.reshape(128, -1).sum(axis=1) & 1).view(np.int64)
                rows.append((i, len(s), *_class_of(s, bits), *few.tolist(), np.packbits(odd).tobytes()))
                waiting.append((s >> _SHIFT).astype(np.int32))
            if rows:
                np.add.at(seen, np.concatenate(waiting), 1)
                yield rows_of(_PROFILE, rows)
        pieces = seen.reshape(-1, PIECE)
        counted = [(i, task % parts, zlib.compress(own.tobytes(), 1)) for i, own in enumerate(pieces) if own.any()]
        if counted:
            yield rows_of(_COUNTED, counted)

    return docs.mapInArrow(run, ", ".join(f"{f.name} { {pa.int64(): 'long', pa.int32(): 'int', pa.binary(): 'binary'}[f.type]}" for f in schema))


def _rare_first(counted: DataFrame) -> np.ndarray:
    """For each value of a hash's top bits, its place among them by how often it occurs."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(zlib.decompress(counts), dtype=np.int64)
                sums[piece] = sums[piece] + own if piece in sums else own
        for piece, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([zlib.compress(own.tobytes(), 1)], pa.binary())], ["piece", "counts"])

    schema = "piece int, counts binary"
    parts = counted.repartition("piece", "part").select("piece", "counts").mapInArrow(total, schema)
    seen = np.zeros(1 << COUNT_BITS, dtype=np.int64)
    for row in parts.repartition("piece").mapInArrow(total, schema).collect():
        seen[row.piece * PIECE : (row.piece + 1) * PIECE] = np.frombuffer(zlib.decompress(row.counts), dtype=np.int64)
    place = np.empty(len(seen), dtype=np.uint32)
    place[np.argsort(seen, kind="stable")] = np.arange(len(seen), dtype=np.uint32)
    return place


def _postings(docs: DataFrame, k: int, percent: int, place: np.ndarray, bits: int, shared: frozenset[int]) -> DataFrame:
    """(token, class, n, pos): the prefix of each distinct set; a task posts a set once."""
    order = docs.sparkSession.sparkContext.broadcast(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, posted = order.value, set()
        out: list[tuple[np.ndarray, int, int]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            size = [len(x[0]) for x in out]
            tokens = np.concatenate([x[0] for x in out])
            pos = np.arange(len(tokens)) - np.repeat(np.cumsum(size) - size, size)
            rows = [_signed(tokens), pa.array(np.repeat(np.array([x[1] for x in out], dtype=np.int64), size)), pa.array(np.repeat(np.array([x[2] for x in out], dtype=np.int32), size)), pa.array(pos.astype(np.int32))]
            out.clear()
            return pa.RecordBatch.from_arrays(rows, ["token", "class", "n", "pos"])

        for _, s in _sets(batches, k):
            n = len(s)
            if not n or (own := _name_of(s, bits, shared)) in posted:
                continue
            posted.add(own)
            most = n - (percent * n + 99) // 100 + 1
            ordered = (rank[s >> _SHIFT].astype(np.uint64) << _SHIFT) | (s & _LOW)
            out.append((np.sort(np.partition(ordered, most - 1)[:most]), own, n))
            held += most
            if held > 1 << 16:
                yield flush()
                held = 0
        if out:
            yield flush()

    return docs.mapInArrow(run, "token long, class long, n int, pos int")


def _least_overlap(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The least intersection of two sets of these sizes that link."""
    return (percent * (a + b) + 99 + percent) // (100 + percent)


def _shared(postings: DataFrame, percent: int) -> DataFrame:
    """Postings of which another class's in the same list may be a partner, each with `prev`: the class before it by size, if the pair passes the length and positional filters.

    Lists are read in order of size, so a posting whose neighbours fail the
    length filter has no partner at all, and of two that stand alone the
    positional filter decides, too.
    """
    names = ["token", "class", "n", "pos", "prev"]

    def judged(cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """By posting: whether it stays, and whether it pairs with the one before."""
        token, _, n, pos = cols
        n = n.astype(np.int64)
        a, b = n[:-1], n[1:]
        near = np.zeros(len(n) + 1, dtype=bool)
        near[1:-1] = (token[1:] == token[:-1]) & (100 * a >= percent * b)
        pairs = np.zeros(len(n) + 1, dtype=bool)
        pairs[1:-1] = near[1:-1] & (np.minimum(a - pos[:-1], b - pos[1:]) >= _least_overlap(a, b, percent))
        alone = np.zeros(len(n) + 1, dtype=bool)
        alone[1:-1] = ~near[:-2] & ~near[2:]
        live = near & ~(alone & ~pairs)
        return live[:-1] | live[1:], pairs[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last four rows are read again with the next ones: two are out, two wait for what follows
        held: list[np.ndarray] | None = None
        out = 0

        def rows(cols: list[np.ndarray], begin: int, end: int) -> Iterator[pa.RecordBatch]:
            stay, pairs = judged(cols)
            stay[:begin] = False
            stay[end:] = False
            at = np.flatnonzero(stay)
            if len(at):
                yield pa.RecordBatch.from_arrays([*(pa.array(c[at]) for c in cols), pa.array(cols[1][np.maximum(at - 1, 0)], mask=~pairs[at])], names)

        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if held is not None:
                cols = [np.concatenate([a, b]) for a, b in zip(held, cols, strict=True)]
            fresh = np.ones(len(cols[0]), dtype=bool)
            fresh[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
            cols = [c[fresh] for c in cols]
            end = max(out, len(cols[0]) - 2)
            yield from rows(cols, out, end)
            keep = max(0, len(cols[0]) - 4)
            held, out = [c[keep:].copy() for c in cols], end - keep
        if held is not None and len(held[0]):
            yield from rows(held, out, len(held[0]))

    return postings.repartition("token").sortWithinPartitions("token", "n", "class").mapInArrow(run, "token long, class long, n int, pos int, prev long")


def _open_lists(lists: DataFrame) -> DataFrame:
    """(token, main, rest, most) of the posting lists that still hold several components: the component of most postings (of equals the least), and the postings of the others and of it."""
    by = lists.groupBy("token", "comp").agg(F.count("*").alias("n"))
    top = F.max(F.struct("n", (-F.col("comp")).alias("c"))).alias("top")
    return by.groupBy("token").agg(top, F.sum("n").alias("size"), F.count("*").alias("comps")).where("comps > 1").select("token", (-F.col("top.c")).alias("main"), (F.col("size") - F.col("top.n")).alias("rest"), F.col("top.n").alias("most"))


def _dealt(lists: DataFrame) -> DataFrame:
    """Postings in groups (token, i, j) of two blocks of BLOCK or one, with their own block.

    The postings of a list's largest component need no partner among themselves:
    they meet the blocks of the others alone, and these all blocks.  So a list of n
    in which few stragglers are left is copied about n times, not n^2 / BLOCK.  A
    list of BLOCK or less is one group.
    """
    parts = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    rest, most, inside = parts("rest"), parts("most"), F.col("comp") == F.col("main")
    short = F.col("rest") + F.col("most") <= BLOCK
    rows = lists.withColumn("own", F.when(short, 0).when(inside, rest + F.pmod(F.xxhash64("class"), most)).otherwise(F.pmod(F.xxhash64("class"), rest)).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(short, 0).when(inside, rest - 1).otherwise(rest + most - 1))))
    return rows.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "class", "n", "pos", "comp", "odd1", "odd2")


def _crossing(lists: DataFrame, percent: int, seed: int | None) -> DataFrame:
    """Pairs (a, b) of classes of one posting list in different components that pass the length, positional and suffix filters; with a seed, one for each posting.

    lists: token, class, n, pos, odd1, odd2, comp, and of the token main, rest, most (see _open_lists).  A list of over BLOCK postings is cut into blocks, and pairs of blocks are groups of their own.
    """
    rows = _dealt(lists)

    def pairs_of(g: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        token, i, j, own, cls, n, pos, comp, odd1, odd2 = g
        n, pos = n.astype(np.int64), pos.astype(np.int64)
        odd1, odd2 = odd1.view(np.uint64), odd2.view(np.uint64)
        top = np.searchsorted(n, (100 * n) // percent, side="right")
        left, right = [], []
        for x in range(len(n) - 1):
            y = slice(x + 1, top[x])
            ok = (comp[y] != comp[x]) & (np.minimum(n[x] - pos[x], n[y] - pos[y]) >= _least_overlap(n[x], n[y], percent))
            if i[x] != j[x]:
                ok &= own[y] != own[x]
            near = np.flatnonzero(ok) + x + 1
            if len(near):
                apart = np.bitwise_count(odd1[near] ^ odd1[x]).astype(np.int64) + np.bitwise_count(odd2[near] ^ odd2[x])
                near = near[apart <= n[x] + n[near] - 2 * _least_overlap(n[x], n[near], percent)]
            if len(near):
                others = cls[near]
                if seed is not None and len(others) > 1:
                    others = others[[np.argmin(_text.mix((others ^ cls[x] ^ token[x]).view(np.uint64) + np.uint64(seed)))]]
                right.append(others)
                left.append(np.full(len(right[-1]), cls[x]))
        if not left:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = np.concatenate(left), np.concatenate(right)
        return np.minimum(a, b), np.maximum(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        out = lambda a, b: pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
        for batch in batches:
            cols = [batch.column(x).to_numpy(zero_copy_only=False) for x in range(10)]
            if rest is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(rest, cols, strict=True)]
            if not len(cols[0]):
                continue
            new = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])) + 1
            edges = [0, *new.tolist()]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b - a > 1:
                    got = pairs_of([c[a:b] for c in cols])
                    if len(got[0]):
                        yield out(*got)
            rest = [c[edges[-1] :] for c in cols]
        if rest is not None and len(rest[0]) > 1:
            yield out(*pairs_of(rest))

    return rows.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "n", "class").mapInArrow(run, "a long, b long").distinct()


def _filter_of(needed: DataFrame) -> np.ndarray:
    """A Bloom filter, of fixed size, of a table of longs."""
    at = needed.select(F.explode(F.array(*(F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc"), 64 - FILTER_BITS) for seed in (1, 2)))).alias("bit"))
    words = at.groupBy(F.expr("cast(bit >> 5 as int)").alias("word")).agg(F.expr("bit_or(1L << cast(bit & 31 as int))").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 5), dtype=np.uint32)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)
    return out


def _links(docs: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, percent: int, bits: int, shared: frozenset[int]) -> DataFrame:
    """Those pairs (a, b) of classes that link, as (u, v), their first documents.  Only texts of pairs that pass the finer suffix filter are cut into sets again."""

    def finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint64).reshape(batch.num_rows, -1) for c in ("oa", "ob"))
                ok = pa.array(np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= na + nb - 2 * _least_overlap(na, nb, percent))
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(ok) for c in ("a", "b")], ["a", "b"])

    whose = lambda x: classes.select(F.col("class").alias(x), F.col("n").alias(f"n{x}"), F.col("odd").alias(f"o{x}"))
    pairs = stored(pairs.join(whose("a"), "a").join(whose("b"), "b").select("a", "b", "na", "nb", "oa", "ob").mapInArrow(finer, "a long, b long"))
    needed = stored(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(classes.select("class", "doc"), "class"))
    needed_bits = docs.sparkSession.sparkContext.broadcast(_filter_of(needed.select("doc")))
    wanted = docs.withColumns({f"_b{seed}": F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 64 - FILTER_BITS) for seed in (1, 2)})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = needed_bits.value
        for batch in batches:
            ok = np.ones(batch.num_rows, dtype=bool)
            for c in ("_b1", "_b2"):
                bit = batch.column(c).to_numpy()
                ok &= (held[bit >> 5] >> (bit & 31).astype(np.uint32)) & np.uint32(1) > 0
            for part in _text.slices(batch.filter(pa.array(ok)), "text"):
                own = list(_text.shingle_sets(part.column("text"), k))
                at = np.cumsum([0, *map(len, own)]).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(at), _signed(np.concatenate(own)))
                yield pa.RecordBatch.from_arrays([pa.array([_name_of(s, bits, shared) for s in own], pa.int64()), tokens], ["class", "tokens"])

    sets = wanted.mapInArrow(read, "class long, tokens array<long>").groupBy("class").agg(F.first("tokens").alias("tokens")).join(needed, "class")

    side = lambda x, y: sets.select(F.col("class").alias(x), F.col("doc").alias(y), F.col("tokens").alias(f"t{x}"))
    both = pairs.join(side("a", "u"), "a").join(side("b", "v"), "b")
    # rows of two whole sets stay in the JVM, where they spill; a batch of them for Python would have no bound
    # 100 * inter >= percent * (a + b - inter), written so that the intersection is made once
    links = F.size(F.array_intersect("ta", "tb")) * F.lit(100 + percent).cast("long") >= (F.size("ta") + F.size("tb")) * F.lit(percent).cast("long")
    out = stored(both.where(links).select("u", "v"))
    dropped(needed, pairs)
    return out


def near_duplicates(df: DataFrame, doc: str = "doc_id", text: str = "text", *, k: int = 5, percent: int = 80, name_bits: int = 64) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; component_id is the least doc_id reachable by links.

    name_bits: bits of the first names of sets; sets that share one get another.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must lie in 1 to 100")
    docs = df.select(df[doc].cast("long").alias("id"), df[text].cast("string").alias("text")).where("id is not null")
    read = stored(_profiles(docs, k, name_bits))
    place = _rare_first(read.where("piece is not null").select(*_COUNTED))
    profiles = read.where("piece is null").select(*_PROFILE)
    classes = stored(profiles.where("n > 0").groupBy("n", "class", "class2").agg(F.min("doc").alias("doc"), F.first("odd1").alias("odd1"), F.first("odd2").alias("odd2"), F.first("odd").alias("odd")))
    shared = frozenset(r["class"] for r in classes.groupBy("class").agg(F.count("*").alias("c")).where("c > 1").select("class").collect())
    named = lambda df: df.withColumn("class", F.when(F.col("class").isin(*shared), F.col("class2")).otherwise(F.col("class"))) if shared else df
    profiles, sets = named(profiles), named(classes).drop("class2")
    lists_of = stored(_shared(_postings(docs, k, percent, place, name_bits, shared), percent))

    # a document of several texts ties their classes
    several = profiles.groupBy("doc").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("doc")
    ties = profiles.where("n > 0").join(several, "doc", "left_semi").select("class", F.col("doc").alias("u")).join(sets.select("class", F.col("doc").alias("v")), "class").select("u", "v")
    tested = stored(lists_of.where("prev is not null").select(F.least("class", "prev").alias("a"), F.greatest("class", "prev").alias("b")).distinct())
    links = _links(docs, sets, tested, k, percent, name_bits, shared)
    joined = components(links.unionByName(ties))
    used = [read, classes, lists_of, tested, links, joined]
    for seed in (1, None):
        comp = sets.join(joined.withColumnRenamed("node", "doc"), "doc", "left").select("class", "odd1", "odd2", F.coalesce("component", "doc").alias("comp"))
        lists = lists_of.drop("prev").join(comp, "class")
        pairs = stored(_crossing(lists.join(_open_lists(lists), "token"), percent, seed).join(tested, ["a", "b"], "left_anti"))
        used.append(pairs)
        if not pairs.limit(1).count():
            continue
        links = _links(docs, sets, pairs, k, percent, name_bits, shared)
        tested, joined = tested.unionByName(pairs), components(joined.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(links))
        used += [links, joined]

    comp = sets.join(joined.withColumnRenamed("node", "doc"), "doc", "left").select("class", F.coalesce("component", "doc").alias("component"))
    texts = profiles.select("doc", F.col("n").alias("n_shingles"), "class").join(comp, "class", "left")
    # a text without words has no class; its document may have other texts
    own = joined.select(F.col("node").alias("doc"), F.col("component").alias("own"))
    out = stored(texts.join(own, "doc", "left").select(F.col("doc").alias("doc_id"), "n_shingles", F.coalesce("component", "own", "doc").alias("component_id")))
    dropped(*used)
    return out


def representatives(df: DataFrame, doc: str = "doc_id", text: str = "text", *, k: int = 5, percent: int = 80) -> DataFrame:
    """Rows of `df` whose document is the least of its group; a row with a null id stays."""
    gone = near_duplicates(df, doc, text, k=k, percent=percent).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return df.join(gone, df[doc] == gone["_gone"], "left_anti")
