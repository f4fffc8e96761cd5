"""BM25 within conversations: postings, statistics and the formula."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def postings(corpus: DataFrame) -> DataFrame:
    """conversation_id, id, doc_len, term, tf. A document's terms are counted in its own row, as runs of its sorted
    lexemes, so nothing is shuffled."""
    rows = corpus.select("conversation_id", "id", F.size("lexemes").alias("doc_len"), F.array_sort("lexemes").alias("_sorted")).where("doc_len > 0")
    begins = F.filter(F.sequence(F.lit(1), F.col("doc_len")), lambda i: (i == 1) | (F.get("_sorted", i - 1) != F.get("_sorted", i - 2)))
    rows = rows.withColumn("_begins", begins)
    runs = F.zip_with(
        "_begins",
        F.slice("_begins", F.lit(2), F.greatest(F.size("_begins") - 1, F.lit(1))),
        lambda a, b: F.struct(F.get("_sorted", a - 1).alias("term"), (F.coalesce(b, F.col("doc_len") + 1) - a).alias("tf")),
    )
    return rows.select("conversation_id", "id", "doc_len", F.explode(runs).alias("_run")).select("conversation_id", "id", "doc_len", "_run.term", "_run.tf")


def corpus_stats(corpus: DataFrame) -> DataFrame:
    """conversation_id, n_docs and avg_len; documents without lexemes count."""
    return corpus.groupBy("conversation_id").agg(F.count("*").alias("n_docs"), F.avg(F.size("lexemes")).alias("avg_len"))


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("conversation_id", "term").agg(F.count("*").alias("df"))


def idf(n_docs: Column, df: Column) -> Column:
    return F.log1p((n_docs - df + 0.5) / (df + 0.5))


def term_weight(tf: Column, doc_len: Column, avg_len: Column, k1: float = K1, b: float = B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * doc_len / avg_len))


def bm25(corpus: DataFrame, queries: DataFrame, n: int = 0, k1: float = K1, b: float = B) -> DataFrame:
    """query_id, id, score, rank of the documents that share a term with the query, within its conversation: the search of
    an index that is made for these queries alone. Where a corpus is asked more than once, make the index once."""
    from .index import search, temporary_index  # which has the formula from here

    return search(temporary_index(corpus), queries, n, k1, b)
