"""Multi-party perspective rotation: each dialogue once for every participant, with that speaker as the assistant.

All other participants become named users, speakers with a fixed role (``system``) keep it and have no view of
their own. The mask holds the character spans (start, end) of what the assistant of the view says, end mark
included. Built from DataFrame functions only.

A row holds at most ``part_turns`` turn numbers of a dialogue; a longer one continues in the next ``part``, so no
dialogue has to fit into one row. Defined results: NULL text is empty; a NULL speaker is the user ``unknown`` and
has no view; a NULL turn comes first; turns follow (turn, speaker, text), so repeated rows stay and ties do not
matter; dialogues of fixed roles alone have no view; ``<|`` in texts is written ``< |`` and line breaks in names
as spaces, so that texts cannot forge marks; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def rotate(
    df: DataFrame,
    *,
    conversation: str = "conv_id",
    turn: str = "turn",
    speaker: str = "role",
    text: str = "text",
    fixed: Sequence[str] = ("system",),
    part_turns: int = 4096,
) -> DataFrame:
    """One row per (conversation, speaker, part): ``n_turns``, ``n_own``, ``rendered``, ``mask`` (array of start, end)."""
    said = df.select(
        F.col(conversation).alias("conv_id"),
        F.coalesce(F.floor(F.col(turn) / part_turns), F.lit(0)).cast("int").alias("part"),
        F.col(turn).alias("turn"),
        F.col(speaker).alias("who"),
        F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
    )
    dialogues = said.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "who", "text"))).alias("turns"))
    views = said.where(F.col("who").isNotNull() & ~F.col("who").isin(*fixed)).select("conv_id", F.col("who").alias("speaker")).distinct()
    joined = dialogues.join(views, dialogues["conv_id"].eqNullSafe(views["conv_id"])).drop(views["conv_id"])

    def head(said_turn: Column) -> Column:
        who = said_turn["who"]
        name = F.translate(F.coalesce(who, F.lit("unknown")), "\r\n", "  ")
        role = (
            F.when(who.isin(*fixed), name)
            .when(who == F.col("speaker"), F.lit("assistant"))
            .otherwise(F.concat(F.lit("user name="), name))
        )
        return F.concat(F.lit(OPEN), role, F.lit("\n"))

    marked = joined.withColumn(
        "segments",
        F.transform(
            "turns",
            lambda t: F.struct(
                head(t).alias("head"), t["text"].alias("text"), F.coalesce(t["who"] == F.col("speaker"), F.lit(False)).alias("own")
            ),
        ),
    )
    spans = F.aggregate(
        "segments",
        F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:long,end:long>>)").alias("mask")),
        lambda done, s: F.struct(
            (done["at"] + F.length(s["head"]) + F.length(s["text"]) + F.lit(len(CLOSE))).alias("at"),
            F.when(
                s["own"],
                F.concat(
                    done["mask"],
                    F.array(
                        F.struct(
                            (done["at"] + F.length(s["head"])).alias("start"),
                            (done["at"] + F.length(s["head"]) + F.length(s["text"]) + F.lit(len(CLOSE) - 1)).alias("end"),
                        )
                    ),
                ),
            )
            .otherwise(done["mask"])
            .alias("mask"),
        ),
        lambda done: done["mask"],
    )
    return marked.select(
        "conv_id",
        "speaker",
        "part",
        F.size("segments").cast("long").alias("n_turns"),
        F.size(F.filter("segments", lambda s: s["own"])).cast("long").alias("n_own"),
        F.array_join(F.transform("segments", lambda s: F.concat(s["head"], s["text"], F.lit(CLOSE))), "").alias("rendered"),
        spans.alias("mask"),
    )
