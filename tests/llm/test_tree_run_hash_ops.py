"""Merkle manifest, runs of words and SimHash groups against plain versions, and on odd rows."""

import hashlib
import random

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearfield.llm import merkle, runs, simhash

# Merkle manifest

ROWS = "doc_id long, text string, lang string, tree string, leaf string, part string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(*fields):
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def plain_tree(digests):
    """The levels of a tree, leaves first."""
    levels = [digests]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i : i + 8])) for i in range(0, len(below), 8)])
    return levels


def plain_path(levels, place):
    out = []
    for below in levels[:-1]:
        a = place // 8 * 8
        out.append((place - a, below[a : a + 8]))
        place //= 8
    return out


def plain_manifest(rows, changed):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0], plain_leaf(*r), plain_leaf(*changed(r))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in names:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees.append(plain_tree([x[1] for x in groups[g]]))
    top = plain_tree([t[-1][0] for t in trees])
    out = []
    for n, g in enumerate(names):
        for place, (key, leaf, claim) in enumerate(groups[g]):
            path, folded = plain_path(trees[n], place) + plain_path(top, n), claim
            for at, run in path:
                folded = sha("".join(run[:at] + [folded] + run[at + 1 :]))
            proof = sha("".join("".join(run[:at] + run[at + 1 :]) for at, run in path))
            out.append((key, leaf, trees[n][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def manifest(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], ROWS).repartition(3)
    fields = [F.col("doc_id"), F.col("text"), F.col("lang")]
    return merkle.verified(df, merkle.leaf_of(*fields), merkle.leaf_of(fields[0], F.lower("text"), fields[2]))


@pytest.mark.parametrize("sizes", [{"en": 600, "de": 65, "fr": 64, None: 8, "": 9, "é": 1} | {f"l{i}": 1 + i % 2 for i in range(70)}, {"en": 1}])
def test_manifest_equals_a_plain_one(spark, sizes):
    rng = random.Random(3)
    rows = []
    for lang, n in sizes.items():
        for _ in range(n):
            rows.append((rng.choice([None, -1, *range(2000)]), rng.choice([None, "", "Ab", "ab", "Ärger X", "q" * 50]), lang))
    got = sorted(map(tuple, manifest(spark, rows).collect()), key=repr)
    assert got == plain_manifest(rows, lambda r: (r[0], None if r[1] is None else r[1].lower(), r[2]))
    assert any(not r[-1] for r in got) or len(rows) < 20


def test_manifest_of_equal_rows_long_texts_and_none(spark):
    rows = [(7, "Word " * 200_000, "en")] * 3 + [(7, "a", "en")] * 30
    got = sorted(map(tuple, manifest(spark, rows).collect()), key=repr)
    assert got == plain_manifest(rows, lambda r: (r[0], r[1].lower(), r[2]))
    empty = manifest(spark, [])
    assert empty.count() == 0 and empty.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


# Runs


def plain_runs(words, least=12):
    """By definition: for each period, stretches that it holds for; of equal stretches the least period counts."""
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            a = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - a >= q and i + q - a >= least:
                out.setdefault((a, i + q), q)
            i += i == a
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(1, 12))
def test_runs_equal_those_by_definition(start, repeat):
    for x in (start, (start[:repeat] * 12)[:60] + start[:5]):
        assert [(s, e - s, q) for s, e, q in runs.runs_of(x)] == sorted(plain_runs(x, 0), key=lambda r: (r[0], r[0] + r[1], r[2]))
        words = [b"w%d" % i for i in x]
        assert runs.runs(words) == plain_runs(words)


def hard(n):
    fib = [[0], [0, 1]]
    while len(fib[-1]) < n:
        fib.append(fib[-1] + fib[-2])
    yield fib[-1][:n]
    yield [i.bit_count() & 1 for i in range(n)]
    yield [0] * n
    yield [0, 1] * (n // 2)
    yield ([0] * 50 + [1]) * (n // 51)
    yield [(i & -i).bit_length() for i in range(1, n)]
    yield sum(([0] * k + [1] for k in range(1, int((2 * n) ** 0.5))), [])
    yield sum(([1] * k + [0] for k in range(int((2 * n) ** 0.5), 1, -1)), [])
    yield list(range(n))
    rng = random.Random(5)
    yield [rng.randrange(2) for _ in range(n)]


def test_comparisons_are_linear():
    for n in (2000, 32000):
        for x in hard(n):
            for ranks in (x, [max(x) - r for r in x]):
                assert runs.of_order([*(r + 1 for r in ranks), 0])[1] <= 4 * n + 4


def test_runs_in_prose_equal_those_by_definition():
    rng = random.Random(8)
    for _ in range(300):
        words = [b"w%d" % rng.randrange(30) for _ in range(150)]
        a, q = rng.randrange(100), rng.randrange(1, 20)
        words[a:a] = (words[a : a + q] * 9)[: rng.randrange(12, 60)]
        assert runs.runs(words) == plain_runs(words)


def test_described_rows(spark):
    texts = [None, "", " \t\n", "one two", "A a " * 6, "a b c " * 4 + "tail", "x " * 40_000, "é ü " * 7 + " joined stays"]
    rows = [(i, t, "k", "s") for i, t in enumerate(texts)] + [(None, "a b " * 8, "k", "s"), (5, texts[5], "k", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string, n_runs string")
    for periodic in (False, True):
        got = sorted(map(tuple, runs.described(df, periodic=periodic).collect()), key=repr)
        want = []
        for i, t, *_ in rows:
            words = (t or "").encode().split()
            if periodic and i is not None:
                words = runs.made_periodic(words, __import__("zlib").crc32(b"%d" % i))
            # the plain version is too slow for the long text: one run of one word
            found = plain_runs(words) if len(words) < 1000 else [(0, len(words), 1)]
            best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
            gone = {j for s, n, q in found for j in range(s + q, s + n)}
            kept = b" ".join(w for j, w in enumerate(words) if j not in gone)
            listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
            want.append((i, len(found), *best, best[2] and 1000 * best[1] // best[2], sha(listed), hashlib.sha256(kept).hexdigest()))
        assert got == sorted(want, key=repr)
    assert runs.described(df.limit(0)).count() == 0
    left = {r.doc_id: r for r in runs.without_repeats(df).collect() if r.doc_id is not None}
    assert left[5].text == "a b c tail" and left[0].text is None and left[2].text == " \t\n" and left[6].text == "x" and left[5].n_runs == "s"


# SimHash


def plain_print(text, k=4):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(prints, radius):
    """By document, the least one reachable; prints: (doc_id, fingerprint)."""
    low = {i: i for i, _ in prints}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for n, (i, a) in enumerate(prints):
        for j, b in prints[:n]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(i), find(j)
                low[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in prints}


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 5])
def test_masks_cover_every_pair_within_the_radius(radius):
    rng = random.Random(radius)
    for level in range(3):
        tables = simhash.masks(radius, level)
        assert len(tables) == 2 ** (radius + 1) - 1
        for _ in range(500):
            apart = sum(1 << b for b in rng.sample(range(64), rng.randint(0, radius)))
            assert any(not apart & m for m in tables)


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="aB \n\té ", max_size=60))
def test_fingerprint_by_definition(text):
    assert simhash.fingerprint(text, 4) == plain_print(text)


def test_fingerprint_of_a_long_text():
    rng = random.Random(2)
    text = " ".join(f"w{rng.randrange(50)}" for _ in range(70_000))
    assert simhash.fingerprint(text, 4) == plain_print(text)


def copies(seed, groups, size):
    rng, rows = random.Random(seed), []
    for _ in range(groups):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([3, 30, 200]))]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = f"W{rng.randrange(300)}"
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    return [(3 * i + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("small", [3, 1024])
def test_groups_equal_those_of_all_pairs(spark, small):
    rows = [*copies(1, 4, 40), *[(1000 + i, t) for i, t in enumerate([None, "", " ", "One two", "one TWO", "one two three"])], (1, "other text"), (7, None), (7, None)]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows] + [(None, "a b", "x", "y", "z")], "doc_id long, text string, print string, node string, mask string")
    got = simhash.near_duplicates(df, small=small).collect()
    prints = [(i, plain_print(t)) for i, t in rows]
    want = plain_groups(prints, 4)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, f"{p:016x}", want[i]) for i, p in prints)
    assert len(set(want.values())) < len(want) - 20


def test_dense_buckets_of_fingerprints(spark):
    """A ball of fingerprints, so that buckets stay large for several levels, beside stragglers at 5 bits and more."""
    rng = random.Random(4)
    base = rng.getrandbits(64)
    prints = {base ^ sum(1 << b for b in rng.sample(range(12), rng.randint(0, 6))) for _ in range(300)}
    prints |= {base ^ (0b11111 << 20) ^ (1 << 30 + i) for i in range(10)} | {base ^ (0x3FF << 40)}
    rows = list(enumerate(sorted(prints)))
    signed = [(i, p - (1 << 64) if p >> 63 else p) for i, p in rows]
    made = simhash.fingerprints
    simhash.fingerprints = lambda df, doc, text, k: df.select(F.col("doc_id").alias("doc"), F.col("text").cast("long").alias("print"))
    try:
        df = spark.createDataFrame([(i, str(p)) for i, p in signed], "doc_id long, text string")
        got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, small=8).collect()}
    finally:
        simhash.fingerprints = made
    assert got == plain_groups(rows, 4)


def test_groups_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0
