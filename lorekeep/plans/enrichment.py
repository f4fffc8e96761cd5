"""From texts to ledger events: normalized, tokenized, dated and embedded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.dates import parse_timestamp
from lorekeep.functions.text import format_for_embedding, lexemes, normalize
from lorekeep.operators.embed import Embedder, embed


def enriched(texts: DataFrame, cache: DataFrame, embedder: Callable[[], Embedder], prefix: str = "search_document: ", model: str = "mock", dims: int = 768, stemmed: bool = True) -> DataFrame:
    """texts(id, speaker, text, date_time) to id, status, permanent, error_message, normalized_text, lexemes, ts, embedding,
    content_hash, cached. Lexemes and vectors are of the formatted text, with its date and speaker."""
    ts = parse_timestamp(F.coalesce("date_time", F.lit("")))
    rows = texts.select("id", ts.alias("ts"), F.col("speaker"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("id", "ts", format_for_embedding(F.col("ts"), F.col("speaker"), F.col("text")).alias("text"))
    rows = rows.withColumns({"normalized_text": normalize(F.col("text")), "lexemes": lexemes(F.col("text"), stemmed)})
    vectors = embed(rows.select("id", "text"), cache, prefix, model, embedder, dims)
    out = rows.drop("text").join(vectors, "id")
    return out.withColumn("status", F.when(F.col("embedding").isNotNull(), "done").otherwise("failed"))


def as_events(rows: DataFrame, version: int, attempt: int, at: object) -> DataFrame:
    """Rows for the ledger; failed ones carry their error alone."""
    done = F.col("status") == "done"
    kept = lambda c: F.when(done, F.col(c)).alias(c)
    return rows.select(
        F.col("id").cast("long").alias("memory_id"),
        F.lit(version).cast("smallint").alias("enrichment_version"),
        F.lit(attempt).alias("attempt"),
        "status",
        "permanent",
        "error_message",
        *map(kept, ("normalized_text", "lexemes", "ts", "embedding")),
        at.alias("created_at"),
    )
