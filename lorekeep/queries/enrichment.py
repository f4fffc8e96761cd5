"""Ingest, the embedding cache, and enrichment of texts."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from lorekeep.operators import embed as E
from lorekeep.operators import ledger as L
from lorekeep.functions import keys
from lorekeep.plans.enrichment import enriched

from .views import TURNS_SQL, table, turns, words_sql

PREFIX, MODEL = "search_document: ", "mock"


def _marked(spark, d):
    """All turns uploaded, and those of even conversations again, to a ledger that has the first turns."""
    rows = turns(spark, d)
    again = rows.where(F.col("conversation_id").cast("bigint") % 2 == 0).withColumn("pos", F.col("pos") + 1000)
    return L.new_memories(rows.where("pos = 0"), rows.unionByName(again))


def ingest_dedup(spark, d):
    return _marked(spark, d).select("turn_id", "pos", "accepted")


def ack_counts(spark, d):
    return L.acknowledged(_marked(spark, d))


def _cache(spark, d):
    """The vectors of English documents, as if they had been embedded before."""
    rows = table(spark, d, "documents").where("lang = 'en'").select(keys.cache_key(F.lit(PREFIX), F.coalesce("text", F.lit(""))).alias("content_hash")).distinct()
    return rows.select("content_hash", F.lit(MODEL).alias("model"), F.lit(PREFIX).alias("task_prefix"), F.lit(4).cast("smallint").alias("dims"), F.unhex(F.lit("00" * 16)).alias("vector"), F.lit("2024-01-01").cast("timestamp").alias("created_at"))


def cache_miss(spark, d):
    texts = table(spark, d, "documents").select(F.coalesce("text", F.lit("")).alias("text"))
    return E.cache_misses(texts, _cache(spark, d), PREFIX, MODEL).select(keys.blob_key(F.col("content_hash")).alias("key"))


def cache_rows_by_prefix(spark, d):
    queries = table(spark, d, "benchmark").select(keys.cache_key(F.lit("search_query: "), F.col("text")).alias("content_hash"), F.lit("search_query: ").alias("task_prefix")).distinct()
    return E.rows_by_prefix(_cache(spark, d).select("content_hash", "task_prefix").unionByName(queries))


def embed_outcomes(spark, d):
    """Documents embedded whole by a service that refuses some texts, with the cache before it."""
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    service = partial(E.MockEmbedder, 4, "License", True)
    rows = E.embed(texts, _cache(spark, d), PREFIX, MODEL, service, 4, most_bytes=0)
    return rows.select("id", "cached", F.col("embedding").isNotNull().alias("embedded"), "permanent", "error_message")


def enriched_turns(spark, d):
    rows = enriched(turns(spark, d).withColumnRenamed("turn_id", "id"), _cache(spark, d), partial(E.MockEmbedder, 4), dims=4)
    return rows.select("id", "status", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("ts"), F.size("lexemes").alias("n"), F.octet_length("embedding").alias("bytes"))


def matched_twins(spark, d):
    """Documents as fetched rows, matched by content with those of one half of the sources as local ones."""
    rows = table(spark, d, "documents").select("doc_id", "source", keys.content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"))
    local = rows.where("source < 'src2'").select("content_hash", F.col("doc_id").alias("twin"), F.col("doc_id").alias("pos"))
    return L.with_twins(rows, local).select("doc_id", "twin")


def fetched_texts(spark, d):
    """Each labelled document's source and whole text, found by its id."""
    refs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    found = L.strict_lookup(table(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality"), refs)
    return found.select("id", "quality", "source", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


QUERIES = {f.__name__: f for f in (matched_twins, fetched_texts, ingest_dedup, ack_counts, cache_miss, cache_rows_by_prefix, embed_outcomes, enriched_turns)}

_MARKED = f"""{TURNS_SQL},
a AS (SELECT turn_id, pos FROM turns UNION ALL SELECT turn_id, pos + 1000 FROM turns WHERE CAST(conversation_id AS BIGINT) % 2 = 0),
m AS (SELECT turn_id, pos, row_number() OVER (PARTITION BY turn_id ORDER BY pos) = 1 AND turn_id NOT IN (SELECT turn_id FROM turns WHERE pos = 0) AS accepted FROM a)"""
_KEYS = "k AS (SELECT doc_id, lang, coalesce(text, '') AS t, sha256('search_document: ' || coalesce(text, '')) AS key FROM documents), c AS (SELECT DISTINCT key FROM k WHERE lang = 'en')"
SQL = {
    "enriched_turns": f"""WITH {TURNS_SQL} SELECT turn_id AS id, 'done' AS status, '2023-05-02 10:15' AS ts,
  CAST(len({words_sql("'[2023-05-02] ' || CASE WHEN coalesce(speaker, '') <> '' THEN speaker || ': ' ELSE '' END || coalesce(text, '')")}) AS INT) AS n, 16 AS bytes FROM turns""",
    "matched_twins": """WITH k AS (SELECT doc_id, source, sha256(coalesce(text, '')) AS key FROM documents),
l AS (SELECT key, max(doc_id) AS twin FROM k WHERE source < 'src2' GROUP BY key) SELECT doc_id, twin FROM k JOIN l USING (key)""",
    "fetched_texts": "SELECT doc_id AS id, quality, source, md5(coalesce(text, '')) AS text_md5 FROM labels JOIN documents USING (doc_id)",
    "ingest_dedup": f"WITH {_MARKED} SELECT * FROM m",
    "ack_counts": f"WITH {_MARKED} SELECT count(*) FILTER (WHERE accepted) AS accepted, count(*) FILTER (WHERE NOT accepted) AS deduped FROM m",
    "cache_miss": f"WITH {_KEYS} SELECT DISTINCT key FROM k WHERE key NOT IN (SELECT key FROM c)",
    "cache_rows_by_prefix": f"WITH {_KEYS} SELECT 'search_document: ' AS task_prefix, count(*) AS n FROM c UNION ALL SELECT 'search_query: ', count(DISTINCT text) FROM benchmark",
    "embed_outcomes": f"""WITH {_KEYS} SELECT doc_id AS id, key IN (SELECT key FROM c) AS cached, key IN (SELECT key FROM c) OR NOT contains(t, 'License') AS embedded,
  key NOT IN (SELECT key FROM c) AND contains(t, 'License') AS permanent, CASE WHEN key NOT IN (SELECT key FROM c) AND contains(t, 'License') THEN 'refused' END AS error_message FROM k""",
}
