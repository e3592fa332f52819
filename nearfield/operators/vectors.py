"""Vector operators: neighbours and retrieval metrics, pooling, zero-shot classes, 2-D layouts."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions.arrays import dot, norm, softmax, unit
from nearfield.operators.quantiles import quantiles
from nearfield.working import dropped, stored

TIE_MARGIN, MELODIC_SHARE, RHYTHMIC_SHARE, CLASS_CONFIDENCE = 0.15, 0.7, 0.3, 0.5
#: Rows of a block, and of a cell on average: larger ones move fewer copies of rows, smaller ones make more tasks.
BLOCK, LARGEST, BLOCKS = 4096, 1 << 15, 16
#: Rows and columns of a product.
_ROWS, _COLUMNS = 1024, 4096
#: Pairs whose exact product is made at once.
_PAIRS = 1 << 16
#: Numbers in the table of pivots, at most: 32 MB.
PIVOT_NUMBERS = 1 << 22
#: Cells that a query visits after its own before those that are left: the k-th distance gets small first.
NEAREST = 3
#: Bounds are widened by more than the error of distances of unit vectors.
_ERROR = 1e-7


def _directions(x: np.ndarray) -> np.ndarray:
    """Rows over their lengths; rows of length 0 point along a dimension of their own."""
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.hstack([x / np.where(length > 0, length, 1.0), (length == 0).astype(float)])


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances between unit vectors."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ y.T)))


def _best(x: np.ndarray, y: np.ndarray, qs: np.ndarray, ns: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, cosine to 12 places) of each x's k best other y, of equals the first.

    x and y are of length 1 or 0; ns ascend.  Products in single precision tell which pairs may
    be among the best: those that fall short of the k-th by less than twice their
    error.  These alone are multiplied exactly.
    """
    slack = np.float32(4 * (x.shape[1] + 2) * np.finfo(np.float32).eps)
    x4, y4 = x.astype(np.float32), y.astype(np.float32)
    least = np.full(len(x), -np.inf, np.float32)
    at = np.minimum(np.searchsorted(ns, qs), len(ns) - 1)
    own = np.where(ns[at] == qs, at, -1)
    r, c, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for begin in range(0, len(y), _COLUMNS):
        near = x4 @ y4[begin : begin + _COLUMNS].T
        here = np.flatnonzero((own >= begin) & (own < begin + near.shape[1]))
        near[here, own[here] - begin] = -np.inf
        if begin == 0 and near.shape[1] > k:
            least = np.partition(near, near.shape[1] - k, axis=1)[:, -k] - slack
        a, b = np.nonzero(near >= least[:, None])
        b = b + begin
        a, b = a[own[a] != b], b[own[a] != b]
        exact = [np.einsum("ij,ij->i", x[a[i : i + _PAIRS]], y[b[i : i + _PAIRS]]) for i in range(0, len(a), _PAIRS)]
        r, c, s = np.concatenate([r, a]), np.concatenate([c, b]), np.concatenate([s, np.round(np.concatenate([*exact, np.zeros(0)]), 12)])
        order = np.lexsort((c, -s, r))
        r, c, s = r[order], c[order], s[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        r, c, s, place = (v[place < k] for v in (r, c, s, place))
        full = place == k - 1
        least[r[full]] = s[full].astype(np.float32) - slack
    return r, c, s


def sound_vectors(df: DataFrame, id_: str, vector: str) -> DataFrame:
    """(id, v): rows with an id and a vector of the most frequent width (of equals the greater) without null and non-finite components."""
    v = F.col(vector).cast("array<double>")
    whole = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.select(F.col(id_).cast("long").alias("id"), F.when(whole, v).alias("v")).where("id is not null and v is not null and size(v) > 0")
    widths = rows.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("w")).first()
    return rows.where(F.size("v") == (widths["w"] if widths else 0))


def neighbours(df: DataFrame, k: int, id_: str = "vec_id", vector: str = "embedding", *, block: int | None = None, products: Accumulator | None = None) -> DataFrame:
    """(q, n, sim, rank): the k best other rows of every row by cosine, ties to the smaller id.

    An exact join with pivots.  Different vectors are dealt into cells by their
    nearest pivot; a cell's radius is its farthest vector's distance.  By the
    triangle inequality no vector of a cell is nearer to a query than the query's
    distance to the pivot less that radius.  Each query first meets its own cell,
    then the NEAREST ones by that bound, then those whose bound is still below its
    k-th distance.  A cell is cut into blocks; a block and the queries that visit
    it are matrix products of bounded size, which return k rows for each query.
    Where data have no clusters every query visits every block, and what is
    shuffled is rows * blocks: no more than all pairs of blocks.  Blocks grow with
    the table, so that up to half a million rows there are some BLOCKS of them, and from
    then on they have LARGEST rows.

    Equal vectors are one, with its k + 1 least ids; copies make no pairs.

    Defined cases: a null id, a null or empty vector, one with a null or
    non-finite component, or of another width than most, takes no part; a vector of
    length 0 has cosine 0 with every other; of the rows that repeat an id the least
    vector counts; with less than k others there are less than k rows.
    products: counts the inner products made, if given.
    """
    spark = df.sparkSession
    rows = sound_vectors(df, id_, vector).groupBy("id").agg(F.min("v").alias("v"))
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    whose = stored(rows.withColumn("place", place))
    one = whose.where("place = 1")
    count, width = one.agg(F.count("*"), F.max(F.size("v"))).first()
    block = block or min(LARGEST, max(BLOCK, -(-count // BLOCKS)))
    most = max(1, PIVOT_NUMBERS // ((width or 0) + 1))
    # rows of least hash stand for all: about one for each block
    chosen = one.orderBy(F.xxhash64("id"), "id").limit(min(most, max(1, -(-count // block)))).select("v").toArrow()
    if not chosen.num_rows:
        return whose.select(F.col("id").alias("q"), F.col("id").alias("n"), F.lit(0.0).alias("sim"), F.lit(1).alias("rank")).where("false")
    pivots = spark.sparkContext.broadcast(_directions(flat(chosen.column("v"))))

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                d = _distances(_directions(flat(batch.column("v"))), pivots.value)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], ["id", "v", "cell", "far"])

    cells = stored(one.select("id", "v").mapInArrow(assign, "id long, v array<double>, cell int, far double"))
    known = cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).orderBy("cell").collect()
    radius = np.full(chosen.num_rows, -np.inf)
    blocks = np.zeros(chosen.num_rows, dtype=np.int64)
    for r in known:
        radius[r.cell], blocks[r.cell] = r.radius, -(-r.n // block)
    parts = F.array(*(F.lit(int(n)) for n in blocks))
    held = cells.select("id", "v", "cell", F.pmod(F.xxhash64("id"), parts[F.col("cell")]).cast("int").alias("part"))

    def visits(last: int):
        """Rows of (cell, part, id, v) for the blocks that a query visits in this round; kth: its k-th distance so far."""

        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                d = _distances(_directions(flat(batch.column("v"))), pivots.value)
                own = batch.column("cell").to_numpy()
                if last == 0:
                    q, c = np.arange(len(own)), own.astype(np.int64)
                else:
                    bound = d - radius
                    bound[np.arange(len(own)), own] = np.inf
                    order = np.argsort(bound, axis=1, kind="stable")
                    due = np.take_along_axis(bound, order, axis=1) <= batch.column("kth").to_numpy()[:, None] + _ERROR
                    due[:, NEAREST:] &= last == 2
                    due[:, :NEAREST] &= last == 1
                    q, at = np.nonzero(due)
                    c = order[q, at]
                times = blocks[c]
                part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                q, c = np.repeat(q, times), np.repeat(c, times)
                for a in range(0, len(q), block):
                    at = pa.array(q[a : a + block])
                    yield pa.RecordBatch.from_arrays([pa.array(c[a : a + block].astype(np.int32)), pa.array(part[a : a + block].astype(np.int32)), batch.column("id").take(at), batch.column("v").take(at)], ["cell", "part", "id", "v"])

        return run

    def meet(keys: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("q", pa.int64()), ("n", pa.int64()), ("sim", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        ns, order = right.column("id").to_numpy(), np.argsort(right.column("id").to_numpy(), kind="stable")
        ns, y = ns[order], _directions(flat(right.column("v")))[order, :-1]
        out = []
        # a popular block is met by slices of its queries
        for at in range(0, left.num_rows, _ROWS):
            part = left.slice(at, _ROWS)
            qs, x = part.column("id").to_numpy(), _directions(flat(part.column("v")))[:, :-1]
            if products is not None:
                products.add(len(x) * len(y))
            r, c, sim = _best(x, y, qs, ns, k)
            out.append(pa.Table.from_arrays([pa.array(qs[r]), pa.array(ns[c]), pa.array(sim)], schema=schema))
        return pa.concat_tables(out)

    # a vector's copies are as near as can be: they fill up its list at first
    copies = whose.groupBy("v").agg(F.min("id").alias("q"), F.count("*").alias("copies")).select("q", "copies")
    length = F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)
    queries, met, used = cells, None, [whose, cells]
    rounds = 1 + (len(known) > 1) + (len(known) > NEAREST + 1)
    for last in range(rounds):
        # queries that visit a block are salted, so that a block of many visitors is several groups
        dealt = stored(queries.mapInArrow(visits(last), "cell int, part int, id long, v array<double>"))
        crowds = dealt.groupBy("cell", "part").agg((F.floor((F.count("*") - 1) / (4 * block)) + 1).cast("int").alias("salts"))
        asked = dealt.join(crowds, ["cell", "part"]).select("cell", "part", "id", "v", F.pmod(F.xxhash64("id", F.lit(1)), "salts").cast("int").alias("salt"))
        blocks_of = held.join(crowds, ["cell", "part"]).select("cell", "part", "id", "v", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        group = ("cell", "part", "salt")
        found = asked.groupBy(*group).cogroup(blocks_of.groupBy(*group)).applyInArrow(meet, "q long, n long, sim double")
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "n"))
        met = stored((found if met is None else met.unionByName(found)).withColumn("rank", rank).where(F.col("rank") <= k).drop("rank"))
        used += [dealt, met]
        if last < rounds - 1:
            kth = met.groupBy("q").agg(F.when(F.count("*") >= k, F.min("sim")).alias("least"))
            # without k others yet every cell may hold one; rows that copies fill up need no other
            distance = F.when((F.col("copies") > k) & (length > 0), F.lit(-1.0)).when(F.col("least").isNotNull(), F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("least")))).otherwise(F.lit(9.0))
            queries = cells.join(kth.withColumnRenamed("q", "id"), "id", "left").join(copies.withColumnRenamed("q", "id"), "id").select("id", "v", "cell", distance.alias("kth"))

    # back to ids: each different vector stands for its k + 1 least ids, and its copies are neighbours of each other
    some = whose.where(F.col("place") <= k + 1).join(one.select("v", F.col("id").alias("n")), "v").select("n", F.col("id").alias("other"))
    ask = whose.join(one.select("v", F.col("id").alias("q")), "v").select("q", F.col("id").alias("own"))
    alike = one.join(copies.where("copies > 1").withColumnRenamed("q", "id"), "id").select(F.col("id").alias("q"), F.col("id").alias("n"), F.when(length > 0, 1.0).otherwise(0.0).alias("sim"))
    near = met.unionByName(alike).join(some, "n").select("q", F.col("other").alias("n"), "sim")
    # of a vector's list k + 1 are enough for each of its copies
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "n"))
    near = near.withColumn("rank", best).where(F.col("rank") <= k + 1).drop("rank").join(ask, "q").where("own <> n")
    rank = F.row_number().over(Window.partitionBy("own").orderBy(F.desc("sim"), "n"))
    out = stored(near.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("own").alias("q"), "n", "sim", "rank"))
    dropped(*used)
    return out


def precision(near: DataFrame, labels: DataFrame, id_: str, label: str) -> DataFrame:
    """(q, precision, hit): the share of a row's neighbours that have its label, and whether one has."""
    own = labels.select(F.col(id_).alias("q"), F.col(label).alias("lq"))
    other = labels.select(F.col(id_).alias("n"), F.col(label).alias("ln"))
    both = near.join(own, "q").join(other, "n")
    return both.groupBy("q").agg(F.avg((F.col("lq") == F.col("ln")).cast("double")).alias("precision"), F.max((F.col("lq") == F.col("ln")).cast("int")).alias("hit"))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(q, jaccard) of two neighbour lists."""
    sets = [t.groupBy("q").agg(F.collect_set("n").alias(name)) for t, name in ((a, "x"), (b, "y"))]
    return sets[0].join(sets[1], "q").select("q", (F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))).alias("jaccard"))


def separation(df: DataFrame, label: str, vector: str = "embedding") -> DataFrame:
    """One row: mean cosine within and across labels, and their difference; missing where a side has no pairs.

    The sum of all pairs' products is the squared length of the sum of vectors,
    so one aggregation by label replaces all pairs.
    """
    u = df.select(F.col(label).alias("l"), unit(F.col(vector).cast("array<double>")).alias("v"))
    by = u.select("l", F.posexplode("v").alias("i", "x")).groupBy("l", "i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    within = by.groupBy("l").agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum("q").alias("q"), F.max("n").alias("n"))
    a = within.agg(F.sum(F.col("ss") - F.col("q")).alias("in_sum"), F.sum(F.col("n") * (F.col("n") - 1)).alias("in_n"), F.sum("q").alias("q"), F.sum("n").alias("n"))
    b = by.groupBy("i").agg(F.sum("s").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("all_ss"))
    one = a.crossJoin(b)
    within_mean = F.when(F.col("in_n") > 0, F.col("in_sum") / F.col("in_n"))
    across_n = F.col("n") * (F.col("n") - 1) - F.col("in_n")
    across_mean = F.when(across_n > 0, (F.col("all_ss") - F.col("q") - F.col("in_sum")) / across_n)
    return one.select(within_mean.alias("within"), across_mean.alias("across"), (within_mean - across_mean).alias("separation"))


def mean_pooled(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, pos, value): the mean vector of a key, over its length; a zero mean stays zero."""
    parts = df.select(key, F.posexplode(vector).alias("pos", "x")).groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    length = F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy(key)))
    return parts.select(key, "pos", (F.col("m") / F.when(length > 0, length).otherwise(1.0)).alias("value"))


def masked_pool(frames: Column, n: Column, *, with_spread: bool = False) -> Column:
    """The unit mean (and, joined to it, the population deviation) of the first n frames of an array of vectors."""
    used = F.slice(frames, F.lit(1), F.greatest(F.lit(1), F.least(F.size(frames), n)))
    width = F.size(frames[0])
    at = F.sequence(F.lit(0), width - 1)
    mean = lambda i: F.aggregate(used, F.lit(0.0), lambda s, f: s + f[i]) / F.size(used)
    spread = lambda i: F.sqrt(F.aggregate(used, F.lit(0.0), lambda s, f: s + F.pow(f[i] - mean(i), F.lit(2))) / F.size(used))
    out = F.transform(at, mean)
    return unit(F.concat(out, F.transform(at, spread)) if with_spread else out)


#: Prompts in a block.
PROMPTS = 4096
#: Numbers in a batch's product with the prompts, at most.
_PRODUCT = 1 << 22


def flat(vectors: pa.ListArray) -> np.ndarray:
    """Lists of one width as rows, without an object for each number."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def class_scores(items: DataFrame, prompts: DataFrame, id_: str, vector: str) -> DataFrame:
    """(id, class, score): an item's best inner product over each class's prompts; missing for an item of another width.

    prompts: class, vector.  Up to PROMPTS of them go to the tasks, and each batch
    of items is one matrix product with them, in slices of bounded size: items
    aren't copied and nothing is shuffled.  More prompts are dealt into blocks of
    about that many, whose best scores are aggregated.  Prompts of another width
    than the widest are left out.
    """
    own = prompts.select("class", F.col("vector").cast("array<double>").alias("v")).where("class is not null and v is not null")
    own = own.where(F.size("v") == (own.agg(F.max(F.size("v"))).first()[0] or 0))
    blocks = -(-own.count() // PROMPTS)
    if blocks > 1:
        dealt = own.withColumn("b", F.pmod(F.xxhash64("v"), F.lit(blocks)))
        scores = [_block_scores(items, dealt.where(F.col("b") == b), id_, vector) for b in range(blocks)]
        return functools.reduce(DataFrame.unionByName, scores).groupBy(id_, "class").agg(F.max("score").alias("score"))
    return _block_scores(items, own, id_, vector)


def _block_scores(items: DataFrame, prompts: DataFrame, id_: str, vector: str) -> DataFrame:
    own = prompts.select("class", "v").toArrow()
    names = sorted(set(own.column("class").to_pylist()))
    vectors = own.column("v").to_pylist()
    width = len(vectors[0]) if vectors else 0
    # prompts in order of class: a class is a range of columns
    order = np.argsort([names.index(c) for c in own.column("class").to_pylist()], kind="stable")
    matrix = np.array([vectors[i] for i in order], dtype=float).reshape(len(vectors), width)
    starts = np.searchsorted([names.index(own.column("class")[int(i)].as_py()) for i in order], np.arange(len(names)))
    held = items.sparkSession.sparkContext.broadcast(matrix)
    kind = items.schema[id_].dataType.simpleString()
    x = F.col(vector).cast("array<double>")

    def run(batches):
        m = held.value
        for batch in batches:
            step = max(1, _PRODUCT // max(1, len(m)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                if not part.num_rows:
                    continue
                best = np.maximum.reduceat(flat(part.column("v")) @ m.T, starts, axis=1)
                scores = pa.ListArray.from_arrays(pa.array(np.arange(0, best.size + 1, len(names)), pa.int32()), pa.array(best.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("id"), scores], ["id", "scores"])

    if not names:
        return items.select(id_, F.lit(None).cast("string").alias("class"), F.lit(None).cast("double").alias("score")).where("false")
    fits = x.isNotNull() & (F.size(x) == width) & F.forall(x, lambda c: c.isNotNull())
    scored = items.where(fits).select(F.col(id_).alias("id"), x.alias("v")).mapInArrow(run, f"id {kind}, scores array<double>")
    others = items.where(~F.coalesce(fits, F.lit(False))).select(F.col(id_).alias("id"), F.lit(None).cast("array<double>").alias("scores"))
    each = F.explode(F.transform(F.array(*map(F.lit, names)), lambda c, i: F.struct(c.alias("class"), F.try_element_at("scores", i + 1).alias("score")))).alias("e")
    return scored.unionByName(others).select(F.col("id").alias(id_), each).select(id_, "e.class", "e.score")


def zero_shot(scores: DataFrame, id_: str, classes: list[str], scale: float, *, harmonic: Column | None = None, threshold: float = CLASS_CONFIDENCE) -> DataFrame:
    """(id, best, confidence, assigned): softmax of scaled scores; a close call of rhythmic and melodic goes by the harmonic share; below the threshold nothing is assigned.

    A class without prompts scores -1; of equal probabilities the first class in order wins.
    """
    given = scores.groupBy(id_).agg(F.map_from_entries(F.collect_list(F.struct("class", "score"))).alias("_m"), *([F.first(harmonic).alias("_h")] if harmonic is not None else []))
    p = softmax(F.array(*(F.coalesce(F.element_at("_m", F.lit(c)), F.lit(-1.0)) * scale for c in classes)))
    ranked = F.reverse(F.array_sort(F.transform(p, lambda x, i: F.struct(x.alias("p"), (-i).alias("i")))))
    out = given.withColumn("_p", p).withColumn("_r", ranked)
    name = lambda place: F.element_at(F.array(*map(F.lit, classes)), (1 - F.col("_r")[place]["i"]).cast("int"))
    best = name(0)
    if harmonic is not None and len(classes) > 1:
        close = (F.array_contains(F.array(F.lit("rhythmic"), F.lit("melodic")), name(0))) & (F.array_contains(F.array(F.lit("rhythmic"), F.lit("melodic")), name(1))) & (F.col("_r")[0]["p"] - F.col("_r")[1]["p"] < TIE_MARGIN)
        best = F.when(close & (F.col("_h") >= MELODIC_SHARE), "melodic").when(close & (F.col("_h") <= RHYTHMIC_SHARE), "rhythmic").otherwise(best)
    out = out.withColumn("best", best).withColumn("confidence", F.element_at("_p", F.array_position(F.array(*map(F.lit, classes)), F.col("best")).cast("int")))
    return out.select(id_, "best", "confidence", F.when(F.col("confidence") >= threshold, F.col("best")).alias("assigned"))


def stretched(values: DataFrame, value: str, out: str = "t") -> DataFrame:
    """A value between its 5th and 95th percentile as 0..1; missing stays missing."""
    found = quantiles(values, {"low": F.col(value), "high": F.col(value)}, {"low": 0.05, "high": 0.95})
    low, high = found["low"], found["high"]
    if low is None:
        return values.withColumn(out, F.lit(None).cast("double"))
    span = max(high - low, 1e-9)
    x = (F.col(value) - low) / span
    return values.withColumn(out, F.when(x.isNull(), None).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))))


def fitted_box(points: DataFrame, width: float, height: float, margin: float = 0.0) -> DataFrame:
    """Points in a picture: centred, scaled alike in both directions; spans are 1e-9 at least."""
    b = points.agg(*(f(c).alias(f"{n}{c}") for c in "xy" for f, n in ((F.min, "lo"), (F.max, "hi")))).first()
    if b["lox"] is None:
        return points.withColumns({"px": F.lit(None).cast("double"), "py": F.lit(None).cast("double")})
    sx, sy = max(b["hix"] - b["lox"], 1e-9), max(b["hiy"] - b["loy"], 1e-9)
    scale = min((width - 2 * margin) / sx, (height - 2 * margin) / sy)
    return points.withColumns({"px": (F.col("x") - (b["lox"] + b["hix"]) / 2) * scale + width / 2, "py": (F.col("y") - (b["loy"] + b["hiy"]) / 2) * scale + height / 2})


def principal_plane(df: DataFrame, id_: str, vector: str) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(id, x, y), and the centre and two directions that place further vectors.

    Sums of vectors and of their products are aggregated by partition to one
    matrix of width squared; the driver sees nothing else.
    """
    width = df.select(F.size(vector)).first()[0]

    def moments(batches):
        n, s, ss = 0, np.zeros(width), np.zeros((width, width))
        for batch in batches:
            if len(batch):
                x = np.stack(batch["v"].to_numpy())
                n, s, ss = n + len(x), s + x.sum(axis=0), ss + x.T @ x
        yield pd.DataFrame({"n": [n], "s": [s.tolist()], "ss": [ss.ravel().tolist()]})

    parts = df.select(F.col(vector).cast("array<double>").alias("v")).mapInPandas(moments, "n long, s array<double>, ss array<double>")
    total = parts.agg(F.sum("n").alias("n"), *(F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width))).first()
    flat = parts.select(F.posexplode("ss").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").toArrow().column("x").to_numpy().reshape(width, width)
    mean = np.array([total[f"s{i}"] for i in range(width)]) / max(1, total["n"])
    values, vectors = np.linalg.eigh(flat / max(1, total["n"]) - np.outer(mean, mean))
    axes = vectors[:, np.argsort(-values)[:2]].T
    if len(axes) < 2:
        axes = np.vstack([axes, np.zeros((2 - len(axes), width))])
    return placed(df, id_, vector, mean, axes), mean, axes


def placed(df: DataFrame, id_: str, vector: str, mean: np.ndarray, axes: np.ndarray) -> DataFrame:
    """(id, x, y) of vectors in a plane that is fitted already."""
    centred = F.zip_with(F.col(vector).cast("array<double>"), F.array(*(F.lit(float(m)) for m in mean)), lambda a, b: a - b)
    return df.select(id_, *(dot(centred, F.array(*(F.lit(float(a)) for a in axis))).alias(n) for axis, n in zip(axes, "xy", strict=True)))


__all__ = ["class_scores", "fitted_box", "masked_pool", "mean_pooled", "neighbours", "norm", "overlap", "placed", "precision", "principal_plane", "separation", "stretched", "zero_shot"]
