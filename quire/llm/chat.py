"""Multi-party perspective rotation of dialogues, in DataFrame functions only.

For every participant of a conversation the dialogue is rendered with that speaker as ``assistant`` and
all others as named users, with the ranges of characters that a model would be trained on. System
turns stay system turns in every perspective and speak for nobody.

A perspective is one row. Only a dialogue whose turn numbers reach ``segment`` goes on in a further row for
each so many numbers, so that a conversation that holds a third of all rows is many bounded rows; each of
these begins with the conversation's first system turn again. Character ranges count from a row's start;
``n_turns`` counts no repeated turn.

Defined results: a null role is the participant ``unknown``, a null text is empty, a null turn sorts
first (segment null); delimiters inside texts and names become harmless, and names stay on one line;
repeated rows are repeated turns, equal turns sort by role and text; conversations with system turns alone
have no participant and give no row, as an empty table; null conversation ids are one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def _safe(text: Column) -> Column:
    """The delimiters inside a text become harmless."""
    return F.replace(F.replace(text, F.lit("<|im_start|>"), F.lit("<|im_start |>")), F.lit("<|im_end|>"), F.lit("<|im_end |>"))


def _name(role: Column) -> Column:
    """A participant's name as it stands in a head."""
    return F.translate(_safe(role), "\r\n", "  ")


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int = 4096, system: str = "system") -> DataFrame:
    """(conv_id, speaker, segment, n_turns, n_own, rendered, mask): mask holds the ranges (start, end)
    in code points of what the speaker says, its end mark included."""
    rows = turns.select(
        F.col(f"`{conv}`").alias("conv_id"), F.floor(F.col(f"`{turn}`") / segment).cast("long").alias("segment"), F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit("unknown")).alias("role"), _safe(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("text"),
    )
    # who speaks, and the first system turn: partial results keep a large conversation to a row for each task
    spoken = F.when(F.col("role") != system, F.col("role"))
    opening = F.min(F.when(F.col("role") == system, F.struct("turn", "role", "text", "segment")))
    whole = rows.groupBy(F.col("conv_id").alias("of")).agg(F.array_sort(F.collect_set(spoken)).alias("speakers"), opening.alias("opening"))
    blocks = rows.groupBy("conv_id", "segment").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    again = F.col("opening").isNotNull() & (F.col("segment") > F.coalesce(F.col("opening.segment"), F.lit(-(2**62))))
    first = F.struct(F.col("opening.turn").alias("turn"), F.col("opening.role").alias("role"), F.col("opening.text").alias("text"))
    each = blocks.join(whole, F.col("conv_id").eqNullSafe(F.col("of"))).select(
        "conv_id", "segment", F.size("turns").alias("n_turns"), F.when(again, F.concat(F.array(first), F.col("turns"))).otherwise(F.col("turns")).alias("turns"), F.explode("speakers").alias("speaker")
    )
    said = F.transform(
        "turns",
        lambda t: F.struct(
            (t["role"] == F.col("speaker")).alias("own"),
            F.when(t["role"] == F.col("speaker"), F.lit(f"{START}assistant\n"))
            .when(t["role"] == system, F.lit(f"{START}system\n"))
            .otherwise(F.concat(F.lit(f"{START}user name="), _name(t["role"]), F.lit("\n")))
            .alias("head"),
            F.concat(t["text"], F.lit(END)).alias("body"),
        ),
    )
    each = each.withColumn("said", said)
    none = F.array().cast("array<struct<start:int,end:int>>")
    folded = F.aggregate(
        "said",
        F.struct(F.lit(0).alias("at"), none.alias("mask")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["head"]) + F.length(t["body"])).alias("at"),
            F.when(
                t["own"],
                F.concat(acc["mask"], F.array(F.struct((acc["at"] + F.length(t["head"])).alias("start"), (acc["at"] + F.length(t["head"]) + F.length(t["body"])).alias("end")))),
            )
            .otherwise(acc["mask"])
            .alias("mask"),
        ),
    )
    return each.select(
        "conv_id", "speaker", "segment", "n_turns", F.size(F.filter("said", lambda t: t["own"])).alias("n_own"),
        F.array_join(F.transform("said", lambda t: F.concat(t["head"], t["body"])), "").alias("rendered"), folded["mask"].alias("mask"),
    )
