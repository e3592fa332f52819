"""A Merkle manifest of a table, built and verified by supersteps over RDDs.

Each row is a leaf, the SHA-256 of its fields.  In each group (a language, say)
leaves stand in order of their key; while several nodes remain, every FAN
successive ones become the digest of their digests.  What remains is the group's
subroot, and the subroots, in order of their groups, give the root likewise.

Supersteps upward: each node that isn't yet its tree's root sends its digest to
its parent; a parent has all its messages after one superstep, hashes them and
sends on.  All trees rise at once, so there are as many supersteps as the largest
tree has levels, and each has an eighth of the rows of the one before.  Supersteps
downward: the root sends nothing but its own digest; each parent sends each child
what it got itself and the child's siblings, until leaves hold the path that
proves them.  A leaf folds its digest with that path; the row is verified if the
root comes out.  The last message goes to a run of FAN leaves at once.

Places in the order come from a range partitioning: rows are numbered inside
partitions, and of each partition the driver reads its first and last group and
their counts, so what it holds is bounded by the number of partitions, whatever the
groups.  A group may hold any share of the rows.  Each level is written to the
shared folder, which cuts the lineage.

Defined cases: a null field is `-`, any other its UTF-8 length, `:` and its value;
a null group is a group, first of all; null keys come first, rows of one key are
ordered by leaf, and equal rows are leaves of their own; a lone leaf is its own
subroot, a lone subroot the root; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

from pyspark import RDD
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from nearfield.llm._io import dropped, shuffle_parts, stored

#: Nodes that one parent has at most.
FAN = 8

#: A leaf's way to the root: by level, its place in the run and its siblings' digests.
Path = tuple[tuple[int, bytes], ...]

_NUMBERED = "part int, tree long, place long, closing boolean, name string, id long, leaf binary, claimed binary"
_RUN = "tree long, run long, last boolean, digests array<binary>"
_RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def leaf_of(*fields: Column) -> Column:
    """The digest of a row's fields, binary."""

    def one(c: Column) -> Column:
        text = c.cast("string")
        return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.unhex(F.sha2(F.concat(*(one(c) for c in fields)), 256))


def _joined(digests: Iterable[bytes]) -> bytes:
    """The digest of digests, which count as hexadecimal text."""
    return hashlib.sha256(b"".join(digests).hex().encode()).digest()


def folded(digest: bytes, path: Path) -> bytes:
    """The root that a leaf's digest and its path give."""
    for place, siblings in path:
        digest = _joined((siblings[: 32 * place], digest, siblings[32 * place :]))
    return digest


def _numbered(part: int, rows: Iterator[Row]) -> Iterator[tuple]:
    """Rows of a sorted partition with its number, the number of their group in it, their place in that group there, and whether the group ends here as far as this partition shows."""
    held, tree, place = None, 0, 0
    for r in rows:
        if held is not None:
            new = r.name != held.name
            yield (part, tree, place, new, held.name, held.id, held.leaf, held.claimed)
            tree, place = (tree + 1, 0) if new else (tree, place + 1)
        held = r
    if held is not None:
        yield (part, tree, place, True, held.name, held.id, held.leaf, held.claimed)


class _Places:
    """What turns the numbers inside partitions into numbers of the whole order."""

    def __init__(self, numbered: DataFrame) -> None:
        by = numbered.groupBy("part", "tree").agg((F.max("place") + 1).alias("n"), F.first("name").alias("name"))
        end = lambda f: f(F.struct("name", "n"), "tree")
        parts = by.groupBy("part").agg(F.max("tree").alias("last"), end(F.min_by).alias("low"), end(F.max_by).alias("high"), F.max("n").alias("most")).orderBy("part").collect()
        self.first: dict[int, int] = {}  # the tree of a partition's first group
        self.skip: dict[int, int] = {}  # the rows which that group has before
        self.goes_on: dict[int, int] = {}  # the last group of partitions whose next one continues it
        self.trees, self.most = 0, 0
        size, before = 0, None
        for r in parts:
            same = before is not None and before.high.name == r.low.name
            if same:
                self.goes_on[before.part] = before["last"]
            self.first[r.part] = self.trees - 1 if same else self.trees
            self.skip[r.part] = size if same else 0
            self.trees = self.first[r.part] + r["last"] + 1
            size = r.high.n + (self.skip[r.part] if not r["last"] else 0)
            self.most = max(self.most, r.most, size, r.low.n + self.skip[r.part])
            before = r

    def of(self, r: Row) -> tuple[int, int, bool]:
        """(tree, place, whether it is the tree's last leaf) of a numbered row."""
        place = r.place + (self.skip[r.part] if r.tree == 0 else 0)
        return self.first[r.part] + r.tree, place, r.closing and self.goes_on.get(r.part) != r.tree


def _levels(n: int) -> int:
    """Levels of parents over n nodes."""
    out = 0
    while n > 1:
        n, out = -(-n // FAN), out + 1
    return out


Node = tuple[int, int, bool, bytes]


def _is_root(node: Node) -> bool:
    return node[1] == 0 and node[2]


def _rise(spark: SparkSession, nodes: RDD, parts: int) -> DataFrame:
    """One superstep upward: nodes send to their parents; the runs of children that parents received, stored."""
    sent = nodes.filter(lambda x: not _is_root(x)).map(lambda x: ((x[0], x[1] // FAN), (x[1] % FAN, x[2], x[3])))

    def run(got: tuple) -> tuple:
        (tree, run), messages = got
        messages = sorted(messages)
        return tree, run, messages[-1][1], [d for _, _, d in messages]

    runs = sent.groupByKey(parts).map(run)
    return stored(spark.createDataFrame(runs, _RUN, verifySchema=False))


def _parents(runs: DataFrame) -> RDD:
    """The nodes that runs of children make."""
    return runs.rdd.map(lambda r: (r.tree, r.run, r["last"], _joined(map(bytes, r.digests))))


def _shrunk(parts: int, level: int) -> int:
    return max(1, parts // FAN**level)


def _siblings(digests: list[bytes], i: int) -> bytes:
    return b"".join(digests[:i] + digests[i + 1 :])


def _fall(runs: DataFrame, messages: RDD, parts: int) -> RDD:
    """One superstep downward: what parents got goes to each child, with its siblings in front of the path."""

    def send(x: tuple) -> Iterator[tuple]:
        (tree, run), (digests, (subroot, path)) = x
        for i in range(len(digests)):
            yield (tree, run * FAN + i), (subroot, ((i, _siblings(digests, i)), *path))

    own = runs.rdd.map(lambda r: ((r.tree, r.run), [bytes(d) for d in r.digests]))
    return own.join(messages, parts).flatMap(send)


def verified(df: DataFrame, leaf: Column, claimed: Column, *, key: str = "doc_id", group: str = "lang") -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    leaf, claimed: the digest (see leaf_of) that the manifest is made of, and the one
    found when it is checked.  The proof's digest is that of all siblings, from the
    leaf's level to the root's.
    """
    spark = df.sparkSession
    parts = shuffle_parts(spark)
    rows = stored(df.select(df[group].cast("string").alias("name"), df[key].cast("long").alias("id"), leaf.alias("leaf"), claimed.alias("claimed"), F.monotonically_increasing_id().alias("tie")))
    order = ("name", "id", "leaf", "tie")
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    numbered = stored(spark.createDataFrame(ranged.rdd.mapPartitionsWithIndex(_numbered), _NUMBERED, verifySchema=False))
    places = _Places(numbered)
    if not places.trees:
        return spark.createDataFrame([], _RESULT)
    used = [rows, numbered]

    # leaves, in the runs that their parents receive; the run of a lone leaf has no parent
    def sent(r: Row) -> tuple:
        tree, place, last = places.of(r)
        return (tree, place // FAN), (place % FAN, last, r.id, bytes(r.leaf), bytes(r.claimed))

    def run(got: tuple) -> tuple:
        (tree, run), leaves = got
        leaves = sorted(leaves, key=lambda x: x[0])
        return tree, run, leaves[-1][1], [x[3] for x in leaves], [x[2] for x in leaves], [x[4] for x in leaves]

    bottom = stored(spark.createDataFrame(numbered.rdd.map(sent).groupByKey(parts).map(run), f"{_RUN}, ids array<long>, claims array<binary>", verifySchema=False))
    used.append(bottom)

    def lone(r: Row) -> bool:
        return r.run == 0 and r["last"] and len(r.digests) == 1

    # upward: runs by level, and the roots found at each
    many = bottom.rdd.filter(lambda r: not lone(r))
    roots = [bottom.rdd.filter(lone).map(lambda r: (r.tree, bytes(r.digests[0])))]
    nodes = many.map(lambda r: (r.tree, r.run, r["last"], _joined(map(bytes, r.digests))))
    levels: list[DataFrame] = []
    for level in range(1, _levels(places.most) + 1):
        roots.append(nodes.filter(_is_root).map(lambda x: (x[0], x[3])))
        if level == _levels(places.most):
            break
        levels.append(_rise(spark, nodes, _shrunk(parts, level)))
        nodes = _parents(levels[-1])
    subroots = spark.sparkContext.union(roots)
    trees = places.trees
    nodes, over = subroots.map(lambda x: (0, x[0], x[0] == trees - 1, x[1])), []
    for level in range(_levels(trees)):
        over.append(_rise(spark, nodes, _shrunk(parts, level)))
        nodes = _parents(over[-1])
    root = nodes.first()[3]
    used += levels + over

    # downward: first to the subroots, then to the runs of leaves
    messages = spark.sparkContext.parallelize([((0, 0), (b"", ()))], 1)
    for level in reversed(range(len(over))):
        messages = _fall(over[level], messages, _shrunk(parts, level))
    above = messages.map(lambda x: (x[0][1], x[1][1]))

    def entering(found: RDD) -> RDD:
        """Messages to roots of trees."""
        return found.join(above, _shrunk(parts, 1)).map(lambda x: ((x[0], 0), x[1]))

    messages = entering(roots[-1])
    for level in reversed(range(len(levels))):
        messages = _fall(levels[level], messages, _shrunk(parts, level + 1)).union(entering(roots[level + 1]))
    if len(roots) > 1:
        messages = messages.union(entering(roots[0]))

    def proved(x: tuple) -> Iterator[tuple]:
        _, ((alone, ids, digests, claims), (subroot, path)) = x
        for i, (own, digest, claim) in enumerate(zip(ids, digests, claims, strict=True)):
            way = path if alone else ((i, _siblings(digests, i)), *path)
            proof = hashlib.sha256(b"".join(s for _, s in way).hex().encode()).hexdigest()
            found = folded(claim, way)
            yield own, digest.hex(), subroot.hex(), root.hex(), proof, found.hex(), found == root

    runs = bottom.rdd.map(lambda r: ((r.tree, r.run), (lone(r), list(r.ids), [bytes(d) for d in r.digests], [bytes(d) for d in r.claims])))
    out = stored(spark.createDataFrame(runs.join(messages, parts).flatMap(proved), _RESULT, verifySchema=False))
    dropped(*used)
    return out
