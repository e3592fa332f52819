"""Mixing sources to target weights by hierarchical budgeting.

A tree of columns (such as domain, language, source) has weights at every level.
The budget, a share of all tokens, flows down from the root.  Siblings share
their parent's budget by weight; one that can't use its share, because all its
leaves' tokens times `max_epochs` are less, gives the rest to its siblings, and
only what all of them can't use went to the parent's siblings before.  So each
level is filled as water fills joined vessels: budget = min(capacity, weight *
level), with one level per parent.

A leaf then takes its tokens in a seeded order: full epochs first, then the
shortest prefix of the next epoch's order that reaches the rest.  The order is
that of md5(seed:epoch:doc_id), so a larger budget only adds documents.

Leaves' sums are small tables; prefixes are found on sums over hash ranges of
the order first, and only the one range that holds the cut of a leaf is sorted,
so that a leaf that holds a third of all documents isn't gathered anywhere.

Defined cases: a null level counts as ''; a null text has no tokens; documents
without tokens come with the prefix they lie in; a weight that isn't given is
1, and at most 0 keeps a branch empty; rows that repeat a doc_id have equal keys
and come or go together, and so do rows of a leaf without a doc_id that have
equal texts; columns named like `copies` or `tokens` are replaced; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm._io import dropped, stored

#: Hash ranges of a leaf's order: a cut is looked for within one of them.
RANGE_DIGITS = 3
#: A table of this many leaves, of a few short columns, is small enough to broadcast (about 20 MB).
BROADCAST_LEAVES = 100_000


def tokens_of(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def order_key(seed: int, epoch: Column, doc: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc.cast("string"), F.lit(""))))


def document_key(doc: Column, text: Column) -> Column:
    """What tells documents apart: the id, or a digest of the text without one."""
    return F.coalesce(doc.cast("string"), F.concat(F.lit("-"), F.md5(F.coalesce(text.cast("string"), F.lit("")))))


def _weight(level: str, column: Column, weights: dict[str, dict[str, float]]) -> Column:
    given = weights.get(level, {})
    if not given:
        return F.lit(1.0)
    table = F.create_map(*(F.lit(x) for k, v in given.items() for x in (k, float(v))))
    return F.coalesce(F.element_at(table, column), F.lit(1.0))


#: Parts of an octave in which siblings are ordered by how soon they are full.
STEPS = 256


def _fill(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """nodes: parent's columns, name, weight, capacity, budget (the parent's). Adds `own`, the node's budget.

    Siblings are ordered by capacity over weight.  Sums go over parts of that
    order first, so that the many children of one parent are sorted within parts.
    """
    live = nodes.where("weight > 0").withColumn("ratio", F.col("capacity") / F.col("weight")).withColumn("step", F.floor(F.coalesce(F.log2("ratio"), F.lit(-1e6)) * STEPS))
    over = lambda by, order: Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order)
    steps = live.groupBy(*parent, "step").agg(F.sum("capacity").alias("_c"), F.sum("weight").alias("_w"))
    by = over(parent, ["step"])
    steps = steps.withColumn("full", F.coalesce(F.sum("_c").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    steps = steps.withColumn("wide", F.sum("_w").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))).drop("_c", "_w")
    live = live.join(steps, [*parent, "step"])
    within = over([*parent, "step"], ["ratio", name]).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(within), F.lit(0.0))
    live = live.withColumn("used", F.col("full") + before("capacity")).withColumn("open", F.col("wide") - before("weight"))
    live = live.withColumn("level", (F.col("budget") - F.col("used")) / F.col("open"))
    water = live.groupBy(*parent).agg(F.max(F.when(F.col("level") < F.col("ratio"), F.col("level"))).alias("water"))
    live = live.join(water, parent) if parent else live.crossJoin(F.broadcast(water))  # one row
    return live.withColumn("own", F.when(F.col("level") < F.col("ratio"), F.greatest(F.lit(0.0), F.col("weight") * F.col("water"))).otherwise(F.col("capacity"))).drop("ratio", "step", "full", "wide", "used", "open", "level", "water")


def budgets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, float]], percent: float, max_epochs: int) -> DataFrame:
    """leaves: levels' columns and `supply`. Returns them with `own`, whole tokens; branches without weight are left out.

    A level's table is stored, since the next one reads it several times.
    """
    leaves = stored(leaves.withColumn("capacity", (F.col("supply") * max_epochs).cast("double")))
    used = [leaves]
    total = leaves.agg(F.floor(F.coalesce(F.sum("supply"), F.lit(0)) * percent / 100).cast("double").alias("budget"))
    above = None
    for depth, level in enumerate(levels):
        path = levels[: depth + 1]
        # a branch's capacity counts only the leaves that weights leave open
        open_leaves = leaves
        for deeper in levels[depth + 1 :]:
            open_leaves = open_leaves.where(_weight(deeper, F.col(deeper), weights) > 0)
        nodes = open_leaves.groupBy(*path).agg(F.sum("capacity").alias("capacity")).withColumn("weight", _weight(level, F.col(level), weights))
        # the root's budget is one row
        nodes = nodes.join(above, path[:-1]) if above is not None else nodes.crossJoin(F.broadcast(total))
        nodes = stored(nodes)
        above = stored(_fill(nodes, path[:-1], level).select(*path, F.col("own").alias("budget")))
        used += [nodes, above]
    out = stored(leaves.join(above, levels).withColumn("own", F.round("budget").cast("long")).drop("budget", "capacity"))
    dropped(*used)
    return out


def cuts(narrow: DataFrame, levels: list[str], weights: dict[str, dict[str, float]], *, percent: float, max_epochs: int, seed: int) -> DataFrame:
    """By leaf: its supply, budget (own), full epochs, and the last key of the next epoch that is taken ('' for none).

    narrow: the levels' columns, doc, tokens.
    """
    leaves = budgets(narrow.groupBy(*levels).agg(F.sum("tokens").alias("supply")), levels, weights, percent, max_epochs)
    plan = leaves.withColumn("full", F.when(F.col("supply") > 0, F.floor(F.col("own") / F.col("supply"))).otherwise(F.lit(0)).cast("int"))
    plan = plan.withColumn("rest", F.col("own") - F.col("full") * F.col("supply"))
    keyed = narrow.join(_small(plan.where("rest > 0").select(*levels, "full", "rest")), levels)
    keyed = keyed.withColumn("key", order_key(seed, F.col("full"), F.col("doc"))).withColumn("part", F.substring("key", 1, RANGE_DIGITS))
    upto = Window.partitionBy(*levels).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = keyed.groupBy(*levels, "part").agg(F.sum("tokens").alias("sum"), F.first("rest").alias("rest"))
    parts = parts.withColumn("before", F.coalesce(F.sum("sum").over(upto), F.lit(0)))
    # the range where the running sum reaches the rest; it exists, as the rest is less than the supply
    edge = parts.where("before < rest and before + sum >= rest").select(*levels, "part", "before")
    within = Window.partitionBy(*levels).orderBy("key", "doc").rowsBetween(Window.unboundedPreceding, -1)
    inside = keyed.join(edge, [*levels, "part"]).withColumn("upto", F.col("before") + F.coalesce(F.sum("tokens").over(within), F.lit(0)))
    last = inside.where("upto < rest").groupBy(*levels).agg(F.max("key").alias("last"))
    out = stored(plan.join(last, levels, "left").select(*levels, "supply", "own", "full", F.coalesce("last", F.lit("")).alias("last")))
    dropped(leaves)
    return out


def _small(table: DataFrame) -> DataFrame:
    """Broadcast it if a count shows that it is small; else Spark chooses, and splits hot keys."""
    return F.broadcast(table) if table.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES else table


def mixed(df: DataFrame, levels: dict[str, Column], weights: dict[str, dict[str, float]], *, doc: str = "doc_id", text: str = "text", percent: float = 50, max_epochs: int = 1, seed: int = 7, copies: str | None = None, tokens: str | None = None) -> DataFrame:
    """Rows of `df` that the mixture takes.

    levels: the tree's levels from the root on, by name.  weights: by level and value.
    percent: the budget as a share of all tokens.  copies: name of a column with
    how often the mixture takes a row; without it, rows come once each.
    tokens: name of a column with the row's tokens.
    """
    names = list(levels)
    inner = [f"_l{i}" for i in range(len(names))]
    cols = df.columns
    held = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)), *(F.coalesce(v.cast("string"), F.lit("")).alias(i) for v, i in zip(levels.values(), inner, strict=True)))
    named = {i: weights.get(n, {}) for n, i in zip(names, inner, strict=True)}
    id_, text_ = f"c{cols.index(doc)}", F.col(f"c{cols.index(text)}")
    narrow = stored(held.select(*inner, document_key(F.col(id_), text_).alias("doc"), tokens_of(text_).alias("tokens")))
    plan = cuts(narrow, inner, named, percent=percent, max_epochs=max_epochs, seed=seed).where("full > 0 or last <> ''").select(*inner, "full", "last")
    dropped(narrow)
    taken = held.join(_small(plan), inner)
    taken = taken.withColumn("_copies", F.col("full") + F.when(order_key(seed, F.col("full"), document_key(F.col(id_), text_)) <= F.col("last"), 1).otherwise(0)).where("_copies > 0")
    out = [F.col(f"c{i}").alias(c) for i, c in enumerate(cols) if c not in (copies, tokens)]
    out += [F.col(i).alias(n) for i, n in zip(inner, names, strict=True) if n not in cols]
    out += [tokens_of(text_).alias(tokens)] if tokens else []
    return taken.select(*out, *[F.col("_copies").alias(copies)] if copies else [])


#: Target weights of the registered queries.
LANG_WEIGHTS = {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0}
DOMAIN_WEIGHTS = {"0": 4.0, "1": 3.0, "2": 2.0, "3": 1.0}


def domain_of(source: Column) -> Column:
    """Four domains: the number that ends a source's name, modulo 4 (0 without one)."""
    digits = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    return F.when(digits == "", F.lit(0)).otherwise(digits.cast("long") % 4).cast("string")
