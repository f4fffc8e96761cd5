"""Text, dates, vectors and keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.functions import dates, keys, text, vectors
from lorekeep.functions.stemmer import stem
from lorekeep.operators import bm25

from .views import corpus, table, turns, words_sql, TURNS_SQL


def tokenize_docs(spark, d):
    rows = corpus(spark, d)
    return rows.select(F.col("id").alias("doc_id"), F.size("lexemes").cast("long").alias("n"), F.md5(F.array_join("lexemes", " ").cast("binary")).alias("lexemes_md5"))


def stemmed_docs(spark, d):
    rows = table(spark, d, "documents")
    return rows.select("doc_id", F.array_join(text.lexemes(F.col("text")), " ").alias("lexemes"))


def _stems(words):
    return words.map(stem)


def stem_terms(spark, d):
    terms = bm25.document_frequency(bm25.postings(corpus(spark, d)))
    return terms.select("term", F.pandas_udf(_stems, "string")("term").alias("stem"))


def normalize_text(spark, d):
    rows = table(spark, d, "documents")
    return rows.select("doc_id", F.md5(text.normalize(F.col("text")).cast("binary")).alias("normalized_md5"))


def term_frequency(spark, d):
    return bm25.postings(corpus(spark, d)).select(F.col("id").alias("doc_id"), "term", F.col("tf").cast("long").alias("tf"))


def document_frequency(spark, d):
    return bm25.document_frequency(bm25.postings(corpus(spark, d))).select("term", "df")


def doc_length_stats(spark, d):
    return bm25.corpus_stats(corpus(spark, d, F.col("source"))).select("conversation_id", "n_docs", F.round("avg_len", 6).alias("avg_len"))


def format_for_embedding(spark, d):
    rows = table(spark, d, "events")
    return rows.select("event_id", text.format_for_embedding(F.col("ts").cast("timestamp"), F.col("event_type"), F.col("props")).alias("formatted"))


def parse_timestamps(spark, d):
    """Each event's time, written in one of three accepted shapes and read again."""
    rows = table(spark, d, "events")
    ts, kind = F.col("ts").cast("timestamp"), F.col("event_id") % 3
    written = F.when(kind == 0, F.date_format(ts, "h:mm a 'on' d MMMM, yyyy")).when(kind == 1, F.date_format(ts, "yyyy/MM/dd '('EEE')' HH:mm")).otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
    return rows.select("event_id", F.date_format(dates.parse_timestamp(written), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


#: A phrase of each rule, and in SQL the time it tells of `t`; n is a number from 2 to 10.
_SAID = (
    ("it was {n} days ago", "t - to_days(n)"), ("in {n} weeks, not tomorrow", "t + to_days(7 * n)"), ("Yesterday or last year", "t - INTERVAL 1 DAY"), ("what about tomorrow?", "t + INTERVAL 1 DAY"),
    ("a couple of months ago", "t - INTERVAL 2 MONTH"), ("within a year", "t + INTERVAL 1 YEAR"), ("last month, then", "t - INTERVAL 1 MONTH"), ("next week", "t + INTERVAL 7 DAY"),
    ("next Friday", "t + to_days(CAST(1 + (11 - isodow(t)) % 7 AS INT))"), ("past tues", "t - to_days(CAST(1 + (isodow(t) + 4) % 7 AS INT))"), ("this sunday", "t + to_days(CAST(7 - isodow(t) AS INT))"), ("twelve hours ago", "t - INTERVAL 12 HOUR"), ("who said so", "NULL"),
)


def relative_dates(spark, d):
    """A phrase of each rule in turn, from each order's date."""
    rows, n = table(spark, d, "orders"), (F.col("o_orderkey") % 9 + 2).cast("int").cast("string")
    said = F.replace(F.element_at(F.array(*(F.lit(x) for x, _ in _SAID)), (F.col("o_orderkey") % len(_SAID) + 1).cast("int")), F.lit("{n}"), n)
    return rows.select("o_orderkey", F.date_format(dates.query_time(said, F.col("o_orderdate").cast("timestamp")), "yyyy-MM-dd HH").alias("found"))


def l2_norms(spark, d):
    rows = table(spark, d, "embeddings")
    return rows.select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"), F.round(vectors.norm(vectors.l2_normalize(F.col("embedding"))), 5).alias("unit"))


def cosine_pairs(spark, d):
    """Each vector with the next id's."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return rows.join(other, "vec_id").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("next")), 6).alias("cosine"))


def packed_vectors(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", vectors.pack_vector(F.col("embedding")).alias("packed"))
    back = F.aggregate(vectors.unpack_vector(F.col("packed")), F.lit(0.0), lambda s, x: s + x.cast("double"))
    return rows.select("vec_id", F.octet_length("packed").cast("long").alias("bytes"), F.round(back, 6).alias("total"))


def _envelope(rows):
    return rows.withColumn("body", keys.envelope(**{c: F.col(c) for c in keys.ENVELOPE}))


def content_hash(spark, d):
    rows = _envelope(turns(spark, d))
    return rows.select("turn_id", F.octet_length("body").cast("long").alias("byte_size"), keys.blob_key(keys.content_hash(F.col("body"))).alias("s3_key"))


def parsed_envelopes(spark, d):
    rows = _envelope(turns(spark, d)).select(keys.parse_envelope(F.col("body")).alias("e"))
    return rows.select("e.conversation_id", "e.turn_id", "e.speaker", F.md5(F.col("e.text").cast("binary")).alias("text_md5"))


def cache_key(spark, d):
    rows = table(spark, d, "documents")
    key = lambda prefix: keys.blob_key(keys.cache_key(F.lit(prefix), F.coalesce("text", F.lit(""))))
    return rows.select("doc_id", key("search_document: ").alias("document_key"), key("search_query: ").alias("query_key"))


def surrogate_ids(spark, d):
    rows = table(spark, d, "documents").select("source").distinct()
    return rows.select("source", keys.surrogate_id(F.lit("locomo"), F.col("source")).alias("conversation_id"))


def truncated(spark, d):
    rows = table(spark, d, "documents")
    return rows.select("doc_id", F.octet_length(keys.truncate_utf8(F.col("text"))).cast("long").alias("bytes"))


QUERIES = {
    f.__name__: f
    for f in (
        tokenize_docs, stemmed_docs, stem_terms, normalize_text, term_frequency, document_frequency, doc_length_stats, format_for_embedding,
        parse_timestamps, relative_dates, l2_norms, cosine_pairs, packed_vectors, content_hash, parsed_envelopes, cache_key, surrogate_ids, truncated,
    )
}

_LEX = f"WITH docs AS (SELECT doc_id, source, {words_sql('coalesce(text, chr(32))')} AS lex FROM documents)"
_JSON = """
'{"conversation_id":' || to_json(conversation_id) || ',"session_id":' || to_json(session_id) || ',"turn_id":' || to_json(turn_id)
  || CASE WHEN coalesce(speaker, '') <> '' THEN ',"speaker":' || to_json(speaker) ELSE '' END || ',"text":'
  || replace(replace(replace(CAST(to_json(coalesce(text, '')) AS VARCHAR), '&', '\\u0026'), '<', '\\u003c'), '>', '\\u003e')
  || ',"date_time":' || to_json(date_time) || '}'
"""
SQL = {
    "truncated": """SELECT doc_id, CASE WHEN octet_length(encode(text)) <= 1200 THEN octet_length(encode(text))
  ELSE list_max([octet_length(encode(left(text, k))) FOR k IN range(290, 1201) IF octet_length(encode(left(text, k))) <= 1200]) END AS bytes FROM documents""",
    "tokenize_docs": f"{_LEX} SELECT doc_id, CAST(len(lex) AS BIGINT) AS n, md5(array_to_string(lex, ' ')) AS lexemes_md5 FROM docs",
    "normalize_text": r"SELECT doc_id, md5(trim(regexp_replace(lower(text), '[ \t\n\v\f\r]+', ' ', 'g'))) AS normalized_md5 FROM documents",
    "term_frequency": f"{_LEX} SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(lex) AS term FROM docs) GROUP BY ALL",
    "document_frequency": f"{_LEX} SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(lex) AS term FROM docs) GROUP BY ALL",
    "doc_length_stats": f"{_LEX} SELECT source AS conversation_id, count(*) AS n_docs, round(avg(len(lex)), 6) AS avg_len FROM docs GROUP BY source",
    "format_for_embedding": "SELECT event_id, '[' || strftime(ts, '%Y-%m-%d') || '] ' || event_type || ': ' || coalesce(props, '') AS formatted FROM events",
    "parse_timestamps": "SELECT event_id, strftime(CASE WHEN event_id % 3 < 2 THEN date_trunc('minute', ts) ELSE date_trunc('second', ts) END, '%Y-%m-%d %H:%M:%S') AS parsed FROM events",
    "relative_dates": "SELECT o_orderkey, strftime(CASE o_orderkey % " + str(len(_SAID)) + " " + " ".join(f"WHEN {i} THEN {told}" for i, (_, told) in enumerate(_SAID))
    + " END, '%Y-%m-%d %H') AS found FROM (SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS t, CAST(o_orderkey % 9 + 2 AS INT) AS n FROM orders)",
    "l2_norms": "SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, 1.0::DOUBLE AS unit FROM embeddings",
    "cosine_pairs": "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "packed_vectors": "SELECT vec_id, CAST(4 * len(embedding) AS BIGINT) AS bytes, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings",
    "content_hash": f"WITH {TURNS_SQL}, e AS (SELECT turn_id, {_JSON} AS body FROM turns) SELECT turn_id, CAST(strlen(body) AS BIGINT) AS byte_size, sha256(body) AS s3_key FROM e",
    "parsed_envelopes": f"WITH {TURNS_SQL} SELECT conversation_id, turn_id, speaker, md5(coalesce(text, '')) AS text_md5 FROM turns",
    "cache_key": "SELECT doc_id, sha256('search_document: ' || coalesce(text, '')) AS document_key, sha256('search_query: ' || coalesce(text, '')) AS query_key FROM documents",
    "surrogate_ids": "SELECT source, greatest(1, CAST(('0x' || substr(h, 1, 16))::UBIGINT & 9223372036854775807::UBIGINT AS BIGINT)) AS conversation_id FROM (SELECT source, sha256('locomo/' || source) AS h FROM (SELECT DISTINCT source FROM documents))",
}
