"""Preference pairs of conversations: a shared prompt, rendered once, and two masked completions.

Each conversation is gathered into one list of its turns, in one shuffle, as it will be one row of the
result in any case. The first turn at which the chosen and the rejected list of a pair differ
(in role or text, or because one side has none) ends the prompt; a pair without such a turn is
all prompt and has empty completions. Completions are lists of segments, whose texts in a row
are the completion; `trained` marks what a model learns from, which is the text and end mark of
the assistant's turns. All steps on lists take time in proportion to their length.

Turns with a null pair or conversation id belong to no pair. A null turn number comes after all others, a null
role is `unknown`, a null text is empty. Rows of equal turn number are one turn, ordered by
role and text; repeated rows repeat. A side without turns gives an empty completion. Other
columns don't matter. Empty tables give an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"
HEAD, TAIL = "<|{}|>\n", "<|end|>\n"
LATEST = 2**63 - 1
TURNS = "array<struct<turn:bigint,role:string,text:string>>"


def conversations_of(table: DataFrame, id_column: str, turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """`pair_id` and `turns`, in order, of a table with one row per turn."""
    turn = F.struct(
        F.coalesce(F.col(f"`{turn_column}`").cast("long"), F.lit(LATEST)).alias("turn"),
        F.coalesce(F.col(f"`{role_column}`"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"),
    )
    rows = table.select(F.col(f"`{id_column}`").alias("pair_id"), turn.alias("turn")).where("pair_id IS NOT NULL")
    return rows.groupBy("pair_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))


def side_by_side(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """`pair_id`, `chosen` and `rejected` of two tables as of `conversations_of`."""
    left = chosen.withColumnRenamed("turns", "chosen")
    right = rejected.withColumnRenamed("turns", "rejected")
    nothing = F.array().cast(TURNS)
    return left.join(right, "pair_id", "full").select(
        "pair_id", *[F.coalesce(side, nothing).alias(side) for side in ("chosen", "rejected")]
    )


def with_foreign_reply(conversations: DataFrame) -> DataFrame:
    """Pairs of conversations as of `conversations_of` and themselves up to their last assistant turn, whose
    place the last assistant turn of another takes, the one whose id differs in the last bit.

    Without such a turn of its own, a conversation is its own rejected side; without one of the other, the reply is missing.
    """
    replies = F.filter("turns", lambda t: t["role"] == ASSISTANT)
    found = conversations.withColumn("reply", F.try_element_at(replies, F.lit(-1)))
    foreign = found.where("reply IS NOT NULL").select(
        F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), F.col("reply.text").alias("foreign")
    )
    joined = found.join(foreign, "pair_id", "left")
    kept = F.filter("turns", lambda t: t["turn"] < F.col("reply")["turn"])
    reply = F.struct(F.col("reply")["turn"].alias("turn"), F.lit(ASSISTANT).alias("role"), F.col("foreign").alias("text"))
    replaced = F.when(F.col("foreign").isNull(), kept).otherwise(F.concat(kept, F.array(reply)))
    return joined.select(
        "pair_id", F.col("turns").alias("chosen"), F.when(F.col("reply").isNull(), F.col("turns")).otherwise(replaced).cast(TURNS).alias("rejected")
    )


def segments(turn: Column) -> Column:
    """What a turn renders to: its head, and its text with the end mark."""
    before, after = HEAD.split("{}")
    head = F.struct(F.concat(F.lit(before), turn["role"], F.lit(after)).alias("text"), F.lit(False).alias("trained"))
    body = F.struct(F.concat(turn["text"], F.lit(TAIL)).alias("text"), (turn["role"] == ASSISTANT).alias("trained"))
    return F.array(head, body)


def joined_text(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda s: s["text"]), "")


def format_pairs(pairs: DataFrame) -> DataFrame:
    """One row per pair (`pair_id`, `chosen`, `rejected`): `pair_id`, `prompt_turns`, `prompt`, and both completions."""
    same = F.zip_with("chosen", "rejected", lambda c, r: c.eqNullSafe(r))
    at = F.array_position(same, F.lit(False)).cast("int")
    # At the first difference of the ordered lists, the earlier turn is the one that differs.
    differs = F.least(F.get("chosen", F.col("at") - 1)["turn"], F.get("rejected", F.col("at") - 1)["turn"])
    marked = pairs.withColumn("at", at).withColumn("differs", F.when(F.col("at") > 0, differs))

    def shared(t: Column) -> Column:
        return F.col("differs").isNull() | (t["turn"] < F.col("differs"))

    def rendered(turns: Column) -> Column:
        return F.flatten(F.transform(turns, segments))

    prompt = F.filter("chosen", shared)
    return marked.select(
        "pair_id",
        F.size(F.array_distinct(F.transform(prompt, lambda t: t["turn"]))).cast("long").alias("prompt_turns"),
        joined_text(rendered(prompt)).alias("prompt"),
        *[rendered(F.filter(side, lambda t: ~shared(t))).alias(side) for side in ("chosen", "rejected")],
    )
