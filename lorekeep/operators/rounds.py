"""Turns to rounds of two speakers, and between the two granularities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def assemble_rounds(turns: DataFrame) -> DataFrame:
    """turns(conversation_id, session_id, turn_id, speaker, text, pos, date_time, ...), pos counting a conversation's turns,
    with round_no, from 0 within the session, and seat, 1 or 2, added.

    A turn joins the open round if that has one turn, of the same session and another speaker. So a turn that can't follow
    the one before begins an island, and an island is dealt in twos: no loop. Windows are of a session's turns, and a turn
    of another session in between shows as a gap in pos."""
    session = Window.partitionBy("conversation_id", "session_id").orderBy("pos")
    breaks = F.coalesce((F.lag("pos").over(session) != F.col("pos") - 1) | F.lag("speaker").over(session).eqNullSafe(F.col("speaker")), F.lit(True))
    rows = turns.withColumn("_break", breaks.cast("int")).withColumn("_island", F.sum("_break").over(session))
    island = Window.partitionBy("conversation_id", "session_id", "_island").orderBy("pos")
    rows = rows.withColumn("seat", ((F.row_number().over(island) - 1) % 2 + 1).cast("int"))
    return rows.withColumn("round_no", (F.sum(F.when(F.col("seat") == 1, 1).otherwise(0)).over(session) - 1).cast("int")).drop("_break", "_island")


def rounds(turns: DataFrame) -> DataFrame:
    """One row per round: round_id, turn_ids, text with a line for each turn, and the date of the first."""
    seated = assemble_rounds(turns)
    turn = F.struct("seat", "turn_id", "speaker", "text", "date_time", "pos")
    rows = seated.groupBy("conversation_id", "session_id", "round_no").agg(F.array_sort(F.collect_list(turn)).alias("_turns"))
    line = lambda t: F.concat(t["speaker"], F.lit(": "), t["text"])
    return rows.select(
        "conversation_id",
        "session_id",
        "round_no",
        F.concat_ws(":", "session_id", F.lit("round"), "round_no").alias("round_id"),
        F.transform("_turns", lambda t: t["turn_id"]).alias("turn_ids"),
        F.array_join(F.transform("_turns", line), "\n").alias("text"),
        F.get("_turns", F.lit(0))["date_time"].alias("date_time"),
        F.get("_turns", F.lit(0))["pos"].alias("pos"),
    )


def round_items(turns: DataFrame) -> DataFrame:
    """The rounds of two turns as items: id a+b, no speaker, and what they stand for."""
    whole = rounds(turns).where(F.size("turn_ids") == 2)
    return whole.select("conversation_id", "session_id", F.array_join("turn_ids", "+").alias("id"), F.lit("").alias("speaker"), "text", "date_time", "pos", F.col("turn_ids").alias("members"))


def at_granularity(items: DataFrame, granularity: str) -> DataFrame:
    """items(conversation_id, id, members, ...), members null for a turn. turn: turns alone; round: rounds and the turns
    that no round covers; all: both."""
    if granularity in ("all", ""):
        return items
    turns, whole = items.where("members is null"), items.where("members is not null")
    if granularity == "turn":
        return turns
    if granularity != "round":
        raise ValueError(f"no granularity is called {granularity}")
    covered = whole.select("conversation_id", F.explode("members").alias("id")).distinct()
    return whole.unionByName(turns.join(covered, ["conversation_id", "id"], "left_anti"))


def expanded(retrieved: Column, members: Column) -> Column:
    """An array of ids with rounds replaced by their turns, each the first time it comes; members: the turns of each id,
    as an array in the same order, null for a turn."""
    parts = F.zip_with(retrieved, members, lambda i, m: F.coalesce(m, F.array(i)))
    return F.array_distinct(F.flatten(parts))
