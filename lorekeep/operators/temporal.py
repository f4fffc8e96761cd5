"""Candidates near the time that a question is about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranking import top_n


def in_window(ts: str, query_time: str, window_seconds: float) -> Column:
    """Both ends are inside; a row without a time isn't."""
    away = F.abs(F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col(query_time).cast("timestamp")))
    return F.coalesce(away <= int(window_seconds * 1_000_000), F.lit(False))


def temporal_adjust(candidates: DataFrame, window_seconds: float = 14 * 86400.0, boost: float = 1.3, hard: bool = False) -> DataFrame:
    """candidates(query_id, id, score, ts, query_time, ...), ranked anew.

    Soft: scores in the window are multiplied. Hard: the others go, unless none would be left of a query's rows. A query
    without a time keeps its scores."""
    near = in_window("ts", "query_time", window_seconds)
    if not hard:
        score = F.when(near, F.col("score") * boost).otherwise(F.col("score"))
        return top_n(candidates.drop("rank").withColumn("score", score))
    rows = candidates.withColumn("_near", near).withColumn("_any", F.max("_near").over(Window.partitionBy("query_id")))
    return top_n(rows.where("_near or not _any").drop("_near", "_any", "rank"))
