"""A dataset from its file to a report: turns and rounds enriched, all questions searched at once, metrics by group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep import schemas
from lorekeep.config import Enrichment, Tuning
from lorekeep.functions.dates import parse_timestamp
from lorekeep.functions.text import lexemes
from lorekeep.functions.vectors import unpack_vector
from lorekeep.operators.embed import Embedder, embed
from lorekeep.operators.rounds import at_granularity, round_items
from lorekeep.plans import retrieval
from lorekeep.plans.enrichment import enriched
from lorekeep.sources.datasets import Dataset
from lorekeep.storage import written


def items(turns: DataFrame, granularity: str) -> DataFrame:
    """Turns and rounds as what is searched: id, members (null for a turn), speaker, text, date_time."""
    alone = turns.withColumn("members", F.lit(None).cast("array<string>")).withColumnRenamed("turn_id", "id")
    every = alone.unionByName(round_items(turns).select(*alone.columns))
    return at_granularity(every, granularity)


def corpus(turns: DataFrame, granularity: str, embedder: Callable[[], Embedder], config: Enrichment) -> DataFrame:
    rows = items(turns, granularity)
    key = F.concat_ws("\x1f", "conversation_id", "id")
    cache = turns.sparkSession.createDataFrame([], schemas.CACHE)
    texts = rows.select(key.alias("id"), "speaker", "text", "date_time")
    found = enriched(texts, cache, embedder, config.document_prefix, config.model, config.dims).where("status = 'done'")
    facts = rows.select(key.alias("_key"), "conversation_id", "id", "session_id", "members")
    out = facts.join(found.withColumnRenamed("id", "_key").select("_key", "lexemes", "ts", "embedding"), "_key")
    return out.withColumn("embedding", unpack_vector(F.col("embedding"))).drop("_key")


def evaluate(data: Dataset, tuning: Tuning, embedder: Callable[[], Embedder], config: Enrichment = Enrichment()) -> DataFrame:
    docs = written(retrieval.validated(corpus(data.turns, tuning.granularity.value, embedder, config), config.dims))
    asked = data.questions.withColumn("text", F.col("question"))
    cache = asked.sparkSession.createDataFrame([], schemas.CACHE)
    vectors = embed(asked.select(F.col("query_id").alias("id"), "text"), cache, config.query_prefix, config.model, embedder, config.dims)
    vectors = vectors.select(F.col("id").alias("query_id"), unpack_vector(F.col("embedding")).alias("embedding"))
    asked = asked.join(vectors, "query_id", "left").withColumn("lexemes", lexemes(F.col("question")))
    asked = written(asked.withColumn("question_date", parse_timestamp(F.coalesce("question_date", F.lit("")))))
    chosen = retrieval.search(docs, asked, tuning.search)
    members = docs.select("conversation_id", "id", "members")
    chosen = chosen.join(asked.select("query_id", "conversation_id"), "query_id").join(members, ["conversation_id", "id"])
    gold = asked.select("query_id", "grp", F.coalesce("evidence", F.array().cast("array<string>")).alias("gold"))
    return retrieval.report_of(chosen, gold)
