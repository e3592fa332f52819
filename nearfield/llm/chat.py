"""Preference formatting: one prompt and two masked completions for each pair.

A pair has a chosen and a rejected conversation.  Their longest common prefix of
turns (equal role and text) is rendered once, as the prompt; what follows on
each side is its completion.  A completion's mask lists the spans of code points
to train on: the texts of `trained` roles with their end mark.  Only DataFrame
functions are used.

A pair's turns make one row, as its rendering does; pairs are never gathered
with others.

Defined cases: a null role or text is empty; a turn without a number, or of no
pair, is left out; turns of one number are ordered by role and text; a side
without turns has an empty completion, and then the prompt is empty; equal sides
are all prompt, both completions are empty, and `tie` is true; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, END = "<|im_start|>", "<|im_end|>\n"


def _head(turn: Column) -> Column:
    return F.concat(F.lit(BEGIN), turn["role"], F.lit("\n"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(END))), "")


def _mask(turns: Column, trained: tuple[str, ...]) -> Column:
    """Spans [start, end) of a rendering, as 'start-end' joined by commas."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def add(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(_head(t))
        end = begin + F.length(t["text"]) + len(END)
        span = F.concat(begin.cast("string"), F.lit("-"), end.cast("string"))
        return F.struct(end.alias("at"), F.when(t["role"].isin(*trained), F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, add, lambda acc: F.array_join(acc["spans"], ","))


def formatted(chosen: DataFrame, rejected: DataFrame, pair: str = "pair_id", turn: str = "turn", role: str = "role", text: str = "text", *, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(pair_id, prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask, tie), a row for each pair of either table."""

    def side(df: DataFrame, number: int) -> DataFrame:
        one = F.struct(df[turn].cast("long").alias("turn"), F.coalesce(df[role].cast("string"), F.lit("")).alias("role"), F.coalesce(df[text].cast("string"), F.lit("")).alias("text"))
        return df.where(df[pair].isNotNull() & df[turn].isNotNull()).select(df[pair].cast("long").alias("pair_id"), F.lit(number).alias("side"), one.alias("one"))

    both = side(chosen, 0).unionByName(side(rejected, 1))
    sides = [F.array_sort(F.collect_list(F.when(F.col("side") == n, F.col("one")))).alias(name) for n, name in enumerate("cr")]
    both = both.groupBy("pair_id").agg(*sides)
    short = F.least(F.size("c"), F.size("r"))
    differ = lambda i: ~((F.col("c")[i]["role"] == F.col("r")[i]["role"]) & (F.col("c")[i]["text"] == F.col("r")[i]["text"]))
    at = F.filter(F.when(short > 0, F.sequence(F.lit(0), short - 1)).otherwise(F.array().cast("array<int>")), differ)
    both = both.withColumn("n", F.when(F.size(at) > 0, F.element_at(at, 1)).otherwise(short))
    rest = {name: F.slice(name, F.col("n") + 1, F.size(name)) for name in "cr"}
    return both.select(
        "pair_id",
        F.col("n").alias("prompt_turns"),
        _render(F.slice("c", F.lit(1), F.col("n"))).alias("prompt"),
        _render(rest["c"]).alias("chosen"),
        _render(rest["r"]).alias("rejected"),
        _mask(rest["c"], trained).alias("chosen_mask"),
        _mask(rest["r"], trained).alias("rejected_mask"),
        ((F.size("c") == F.col("n")) & (F.size("r") == F.col("n"))).alias("tie"),
    )


def with_swapped_answer(turns: DataFrame) -> DataFrame:
    """Each conversation with its last assistant turn's text taken from that of its neighbour (conv_id with the last bit turned), a null one as an empty text; without one it stays."""
    last = turns.where("role = 'assistant'").groupBy("conv_id").agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("m"))
    mine = last.select("conv_id", F.col("m.turn").alias("last_turn"))
    other = last.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("m.text").alias("other"))
    swapped = F.when((F.col("turn") == F.col("last_turn")) & (F.col("role") == "assistant"), F.coalesce("other", "text")).otherwise(F.col("text"))
    return turns.select("conv_id", "turn", "role", "text").join(mine.join(other, "conv_id"), "conv_id", "left").select("conv_id", "turn", "role", swapped.alias("text"))
