"""Mixing sources to target weights by systematic sampling.

Each document of a source is expected `target / source_size` times. With the documents of a source in order of size, the
expected copies are prefix-summed (a multiple of the rank, as they are equal), one offset drawn for the source is added,
and a document is emitted once for each integer that its interval crosses. In order of size the words taken differ from
the target by little more than one long document.

Defined cases: null text has size 0; a null source is a source of its own, last in order; a source without words has
target 0 and gives nothing; a very long text counts whole, so a source may miss its target by one such; repeated rows count as documents of their own; of rows that tie in size and id any may be
the one that is taken once more; an empty table gives an empty result. Only the id, text and source columns are read, so
other columns can have any names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, null_safe, ranked, table, written


def word_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size: the number of words of each document."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"))


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2) -> DataFrame:
    """source, source_size, target. The sources, by code point with null last, weigh `weights` in turn and share
    `share` of all words; a target stops at `most` times its source, and what is above goes to the others by weight.
    Each round of that is one aggregate over the sources; two numbers come to the driver."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rows, runs, by = ranked(sources, [], ["source"], "rank")
    turn = F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.col("_at") + F.col("_before") - 1) % len(weights) + 1).cast("int"))
    sources = written(rows.join(runs, by).select("source", "source_size", turn.alias("weight")))
    first = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    goal = share * (first[0] or 0)
    level, full_before = goal / (first[1] or 1), -1
    full = lambda: F.col("source_size") * float(most) <= F.lit(level) * F.col("weight")
    while True:
        n, size, weight = sources.agg(
            F.count_if(full()), F.coalesce(F.sum(F.when(full(), F.col("source_size"))), F.lit(0)), F.sum(F.when(~full(), F.col("weight")))
        ).first()
        if n == full_before or not weight:
            break
        level, full_before = (goal - most * size) / weight, n
    target = F.when(full(), F.col("source_size") * float(most)).otherwise(F.lit(level) * F.col("weight"))
    return sources.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken. `seed` fixes each source's offset."""
    sizes = written(word_sizes(docs))
    targets = source_targets(sizes, weights, share, most)
    rows, runs, by = ranked(sizes, ["source"], ["size", "doc_id"], "rank")
    named = F.concat(F.lit(seed), F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("source"))))
    offset = F.conv(F.substring(F.md5(named.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    runs = null_safe(runs, targets, ["source"]).withColumn("_offset", offset)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rank = (F.col("_at") + F.col("_before")).cast("double")
    copies = (F.floor(rate * rank + F.col("_offset")) - F.floor(rate * (rank - 1) + F.col("_offset"))).cast("long")
    out = null_safe(rows, runs, by).withColumn("copies", copies)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeated(docs: DataFrame, taken: DataFrame) -> DataFrame:
    """The documents as often as the mix takes them, with their own columns. Rows are told by their ids, which should be
    each row's own; one null id is an id like others."""
    rows = docs.select(F.struct("*").alias("row"))
    copies = taken.where("copies > 0").select("doc_id", F.sequence(F.lit(1), F.col("copies").cast("int")).alias("copies"))
    joined = rows.join(copies, rows["row.doc_id"].eqNullSafe(copies["doc_id"]))
    return joined.select("row", F.explode("copies")).select("row.*")


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % 3] AS DOUBLE) AS weight
  FROM d GROUP BY source
), o AS (
  SELECT *, row_number() OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST) AS k FROM s
), l AS (
  SELECT *, 2.0 * source_size / weight AS full_at,
    (1.5 * (SELECT sum(source_size) FROM s) - 2 * coalesce(sum(source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / CAST(sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM o
), v AS (
  SELECT coalesce((SELECT level FROM l WHERE full_at > level ORDER BY k LIMIT 1), 1e300) AS level
), t AS (
  SELECT source, source_size,
    CASE WHEN source_size * CAST(2 AS DOUBLE) <= level * weight THEN source_size * CAST(2 AS DOUBLE) ELSE level * weight END AS target,
    CAST(CAST('0x' || substr(md5(concat('mix', CASE WHEN source IS NULL THEN '-' ELSE '+' || source END)), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u
  FROM s, v
), r AS (
  SELECT doc_id, size, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
    CAST(row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id NULLS LAST) AS DOUBLE) AS k
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(floor(rate * k + u) - floor(rate * (k - 1) + u) AS BIGINT) * size AS taken,
  CAST(floor(rate * k + u) - floor(rate * (k - 1) + u) AS BIGINT) AS copies
FROM r
"""
