"""Recall, NDCG and reciprocal rank of retrieved ids against gold ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUTOFFS = (5, 10)


def hits(retrieved: Column, gold: Column) -> Column:
    """Positions, from 1, of gold ids, each where it comes first."""
    pairs = F.transform(retrieved, lambda x, i: F.when(F.array_contains(gold, x) & (F.array_position(retrieved, x) == i + 1), i + 1))
    return F.filter(pairs, lambda p: p.isNotNull())


def wanted(gold: Column) -> Column:
    return F.size(F.array_distinct(gold))


def _until(found: Column, k: int) -> Column:
    return F.filter(found, lambda p: p <= k) if k > 0 else found


def recall_at(found: Column, wanted: Column, k: int = 0) -> Column:
    """Of hits and the number of gold ids, which may be too many for an array of them."""
    return F.when(wanted > 0, F.size(_until(found, k)) / F.greatest(wanted, F.lit(1))).otherwise(0.0)


def ndcg_at(found: Column, wanted: Column, k: int = 0) -> Column:
    most = F.least(wanted, F.lit(k)) if k > 0 else wanted
    total = lambda positions: F.aggregate(positions, F.lit(0.0), lambda s, p: s + 1 / F.log2(p + 1.0))
    ideal = total(F.sequence(F.lit(1), F.greatest(most, F.lit(1)).cast("int")))
    return F.when(wanted > 0, total(_until(found, k)) / ideal).otherwise(0.0)


def reciprocal_rank_at(found: Column) -> Column:
    return F.coalesce(1 / F.get(found, F.lit(0)), F.lit(0.0))


def recall(retrieved: Column, gold: Column, k: int = 0) -> Column:
    return recall_at(hits(retrieved, gold), wanted(gold), k)


def ndcg(retrieved: Column, gold: Column, k: int = 0) -> Column:
    return ndcg_at(hits(retrieved, gold), wanted(gold), k)


def reciprocal_rank(retrieved: Column, gold: Column) -> Column:
    return reciprocal_rank_at(hits(retrieved, gold))


def evaluate(results: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """report of results(query_id, grp, retrieved, gold), the last two arrays of ids."""
    return report(results.select("grp", hits(F.col("retrieved"), F.col("gold")).alias("hits"), wanted(F.col("gold")).alias("wanted")), cutoffs)


def report(judged: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """judged(grp, hits, wanted), a row for each query, to one row for all (grp null) and one per group: n, skipped, recall_K,
    ndcg_K and mrr. Queries without gold ids are skipped and counted; a group of such alone isn't there."""
    found, most = F.col("hits"), F.col("wanted")
    rows = judged.withColumn("_scored", F.coalesce(most > 0, F.lit(False)))
    measures = {f"recall_{k}": recall_at(found, most, k) for k in cutoffs} | {f"ndcg_{k}": ndcg_at(found, most, k) for k in cutoffs} | {"mrr": reciprocal_rank_at(found)}
    rows = rows.select("grp", "_scored", *(F.when(F.col("_scored"), m).alias(name) for name, m in measures.items()))
    out = rows.groupingSets([[], ["grp"]], "grp").agg(
        F.grouping("grp").alias("overall"),
        F.count_if("_scored").alias("n"),
        F.count_if(~F.col("_scored")).alias("skipped"),
        *(F.coalesce(F.avg(name), F.lit(0.0)).alias(name) for name in measures),
    )
    return out.where("overall = 1 or n > 0")


def within_skip_budget(skipped: Column, questions: Column, most: float = 0.01) -> Column:
    return skipped <= questions * most


def require_recall(report: DataFrame, k: int = 5, least: float = 0.999999) -> DataFrame:
    """The report, which fails when it's read if overall recall is less."""
    fine = (F.col("overall") == 0) | (F.col(f"recall_{k}") >= least)
    message = F.concat(F.lit(f"recall_{k} is "), F.col(f"recall_{k}").cast("string"))
    return report.withColumn(f"recall_{k}", F.when(fine, F.col(f"recall_{k}")).otherwise(F.raise_error(message).cast("double")))
