"""Exact nearest vectors by inner product within conversations, block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import DIGITS, top_n

#: Vectors, and queries, that meet in one matrix product.
ROWS, QUERIES = 4096, 1024


def _blocks(rows: DataFrame, id_: str, size: int, name: str) -> DataFrame:
    """Deals a conversation's rows to as many blocks as their number asks for."""
    counts = rows.groupBy("conversation_id").agg(F.ceil(F.count("*") / size).alias("_n"))
    return rows.join(counts, "conversation_id").withColumn(name, F.pmod(F.xxhash64(id_), F.col("_n"))).withColumnRenamed("_n", f"{name}s")


def dense(corpus: DataFrame, queries: DataFrame, n: int, rows: int = ROWS, asked: int = QUERIES) -> DataFrame:
    """query_id, id, score, rank: the n best of all vectors of the query's conversation, in double precision.

    Corpus blocks and query blocks of one conversation meet in pairs, each a matrix product in Arrow batches that returns
    n rows for each query; then one ranking per query. A document without a vector scores 0 and stays in the list; a query
    whose vector has another length than a document's doesn't find it; a query without a vector finds nothing."""
    docs = _blocks(corpus.select("conversation_id", "id", "embedding"), "id", rows, "block")
    wants = _blocks(queries.where(F.col("embedding").isNotNull()).select("conversation_id", "query_id", F.col("embedding").alias("asked")), "query_id", asked, "part")
    sizes = docs.select("conversation_id", "blocks").distinct().join(wants.select("conversation_id", "parts").distinct(), "conversation_id")
    docs = docs.groupBy("conversation_id", "block").agg(F.collect_list(F.struct("id", "embedding")).alias("docs"))
    wants = wants.groupBy("conversation_id", "part").agg(F.collect_list(F.struct("query_id", "asked")).alias("wants"))
    pairs = sizes.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pairs = pairs.join(docs, ["conversation_id", "block"]).join(wants, ["conversation_id", "part"])
    kinds = {c: t for c, t in (*corpus.select("id").dtypes, *queries.select("query_id").dtypes)}

    def matrix(vectors: pa.Array, dim: int) -> np.ndarray:
        return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for mine, theirs in zip(b.column(0), b.column(1)):
                mine, theirs = mine.values, theirs.values
                length = np.array(mine.field("embedding").value_lengths().fill_null(-1))
                wanted = np.array(theirs.field("asked").value_lengths())
                for dim in np.unique(wanted):
                    fits, take = np.flatnonzero((length == dim) | (length < 0)), np.flatnonzero(wanted == dim)
                    if not len(fits):
                        continue
                    scores = np.zeros((len(take), len(fits)))
                    with_vector = length[fits] == dim
                    if with_vector.any():
                        x = matrix(mine.field("embedding").take(pa.array(fits[with_vector])), dim)
                        scores[:, with_vector] = matrix(theirs.field("asked").take(pa.array(take)), dim) @ x.T
                    scores = np.round(scores, DIGITS) + 0.0
                    ids = mine.field("id").take(pa.array(fits))
                    order = np.argsort(np.array(ids.to_pylist()), kind="stable")  # ties go to the lesser id
                    best = order[np.argsort(-scores[:, order], axis=1, kind="stable")[:, :n]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            theirs.field("query_id").take(pa.array(np.repeat(take, best.shape[1]))),
                            ids.take(pa.array(best.ravel())),
                            pa.array(np.take_along_axis(scores, best, 1).ravel()),
                        ],
                        ["query_id", "id", "score"],
                    )

    found = pairs.select("docs", "wants").mapInArrow(run, f"query_id {kinds['query_id']}, id {kinds['id']}, score double")
    return top_n(found, n)
