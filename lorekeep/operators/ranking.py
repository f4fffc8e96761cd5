"""Ranked lists: rows of query_id, id, score and rank; the best score first, ties to the lesser id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Float sums differ in their last bits with the order of addition; ranks are of scores rounded to this.
DIGITS = 9


def top_n(scored: DataFrame, n: int = 0, by: str = "query_id") -> DataFrame:
    """Adds rank, from 1; n <= 0 keeps all."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), F.asc("id"))
    ranked = scored.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= n) if n > 0 else ranked


def rrf(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """query_id, id, score: the sum of 1 / (k + rank) over any number of ranked lists."""
    every = lists[0].select("query_id", "id", "rank")
    for one in lists[1:]:
        every = every.unionByName(one.select("query_id", "id", "rank"))
    return every.groupBy("query_id", "id").agg(F.round(F.sum(1 / (k + F.col("rank"))), 12).alias("score"))


def max_normalized(scored: DataFrame) -> DataFrame:
    """Adds relevance, the score as a share of its query's best; the score itself if that isn't above 0."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    return scored.withColumn("relevance", F.when(best > 0, F.col("score") / best).otherwise(F.col("score")))
