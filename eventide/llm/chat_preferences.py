"""Preference formatting: chosen and rejected conversations with their common prompt rendered once.

The prompt is the longest common prefix of whole turns (equal role and text). What follows in either
conversation is its completion. Training texts are prompt + completion; a mask of character ranges
says which parts of a completion count for the loss: the assistant's turns, without their headers.

All of it is DataFrame functions. A conversation is gathered by its id, the unit that is rendered;
nothing else is gathered.

Defined cases: turns are ordered by number, then role and text, nulls first; a null role is
`unknown`, a null text is empty; repeated turns stay; a pair of which one side is missing has that
side empty; equal conversations have only a prompt and empty completions; pairs with a null id on
one side have no turns there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = "array<struct<role:string,text:string>>"


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
          role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turns: each conversation's turns in order."""
    one = F.struct(F.col(turn_col).alias("n"),
                   F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"),
                   F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return (conversations.groupBy(F.col(conv_col).alias("conv"))
            .agg(F.array_sort(F.collect_list(one)).alias("t"))
            .select("conv", F.transform("t", lambda x: F.struct(
                x["role"].alias("role"), x["text"].alias("text"))).alias("turns")))


def header(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def rendered(part: Column) -> Column:
    """Turns as one text."""
    return F.array_join(F.transform(part, lambda x: F.concat(
        header(x["role"]), x["text"], F.lit("\n"))), "")


def loss_ranges(part: Column) -> Column:
    """First and past-the-last character of each assistant text in the rendered completion."""
    size = lambda x: F.length(header(x["role"])) + F.length(x["text"]) + 1
    seen = F.aggregate(
        part, F.struct(F.lit(0).alias("at"),
                       F.array().cast("array<struct<first:int,last:int>>").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + size(x)).alias("at"),
            F.when(x["role"] == "assistant", F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + F.length(header(x["role"]))).alias("first"),
                (acc["at"] + size(x) - 1).alias("last")))))
            .otherwise(acc["out"]).alias("out")))
    return seen["out"]


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two turn arrays."""
    differ = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)
                                         | x.isNull() | y.isNull()), F.lit(True))
    return F.when(differ > 0, differ - 1).otherwise(F.size(a)).cast("int")


def formatted(pairs: DataFrame) -> DataFrame:
    """`pairs` (any columns, chosen and rejected turn arrays) with prompt_turns, prompt,
    chosen_completion, rejected_completion, chosen_loss and rejected_loss in their place."""
    kept = [c for c in pairs.columns if c not in ("chosen", "rejected")]
    side = {c: F.coalesce(F.col(c), F.array().cast(TURN)) for c in ("chosen", "rejected")}
    step = pairs.select(*kept, *[v.alias(c) for c, v in side.items()])
    step = step.withColumn("prompt_turns", common_turns(F.col("chosen"), F.col("rejected")))
    rest = {c: F.slice(F.col(c), F.col("prompt_turns") + 1, F.greatest(
        F.size(c) - F.col("prompt_turns"), F.lit(0))) for c in side}
    return step.select(
        *kept, "prompt_turns",
        rendered(F.slice("chosen", F.lit(1), F.col("prompt_turns"))).alias("prompt"),
        *[rendered(rest[c]).alias(f"{c}_completion") for c in side],
        *[loss_ranges(rest[c]).alias(f"{c}_loss") for c in side])


def joined_pairs(pairs: DataFrame, conversations: DataFrame) -> DataFrame:
    """Pairs given by conversation id (columns chosen_id, rejected_id) with their turn arrays."""
    t = turns(conversations)
    for c in ("chosen", "rejected"):
        pairs = pairs.join(t.select(F.col("conv").alias(f"{c}_id"), F.col("turns").alias(c)),
                           f"{c}_id", "left")
    return pairs


def stale_reply_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs out of single conversations: chosen is the conversation, rejected the same up to its
    last assistant turn, whose place the reply before it takes (with one reply: nothing).
    Conversations without an assistant turn have no pair.

    Columns: conv, chosen, rejected."""
    t = turns(conversations)
    places = F.filter(F.sequence(F.lit(1), F.size("turns")),
                      lambda i: F.element_at("turns", i)["role"] == "assistant")
    t = t.withColumn("__at", places).where(F.size("__at") > 0)
    last = F.element_at("__at", -1)
    older = F.when(F.size("__at") > 1, F.slice(
        "turns", F.try_element_at("__at", F.lit(-2)), F.lit(1))).otherwise(F.array().cast(TURN))
    return t.select("conv", F.col("turns").alias("chosen"),
                    F.concat(F.slice("turns", F.lit(1), last - 1), older).alias("rejected"))
