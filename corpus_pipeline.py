"""A training corpus from `documents` in five stages; counted as part of lorekeep.llm.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and is written as Parquet and read again.
All but the last return the columns of documents; the last returns the pieces of packed sequences with their ids.

Defined cases, for all stages: null text is empty text, which the rules reject; very long texts are judged and compared
whole; further columns are carried along under any names; rows without an id or that share one are documents of their own,
told apart by a key that a stage makes; among rows that tie in id and text any may be the one that is kept or taken again;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import common, compress, mixing, packing, rules, similar


def _keyed(docs: DataFrame) -> DataFrame:
    """row (all columns), doc_id, text and source, with a doc_id that each row has for its own and which is in order of the
    ids, null last: the id itself if that tells all rows apart, else the row's place by its id, a hash of its text and its
    number. Written then, as numbers of rows are not the same each time."""
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text", "source")
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        return rows
    numbered = common.written(rows.withColumns({"hash": F.xxhash64("text"), "number": F.monotonically_increasing_id()}))
    order = [F.col("doc_id").asc_nulls_last(), "hash", "number"]
    placed = numbered.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("doc_id", F.monotonically_increasing_id())
    return common.written(placed.drop("hash", "number"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out what a base rule or a risk-controlled cutoff rejects. Each row is judged by its own text."""
    return rules.judged(docs, common.table(spark, sf_dir, "labels"), docs.columns).where("kept").select("row.*")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out what scores less than compress.LEAST_SCORE; the classifier is learned from this stage's input, and each
    row is judged by its own text."""
    model = compress.learn_quality(docs, common.table(spark, sf_dir, "labels"))
    return compress.scored(docs, model, docs.columns).where(F.col("score") >= compress.LEAST_SCORE).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, keeps the document with the least id. SimHash's links are joined by those of
    documents that share at least 0.8 of their five-word shingles, which fingerprints within 2 bits next to never tell.
    Rows without an id, or that share one, are documents of their own: of those, only copies are left out."""
    rows = _keyed(docs)
    found = common.written(similar.grouped(rows.select("doc_id", "text")))
    kept = found.select(F.col("group_id").alias("kept")).distinct()
    return rows.join(kept, rows["doc_id"] == kept["kept"], "left_semi").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for: not at all, once or twice."""
    rows = _keyed(docs)
    return mixing.repeated(rows.select("doc_id", "row"), mixing.mix(rows)).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 ids."""
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_duplicates),
    ("mixing to target weights", mix),
    ("lexical packing", pack),
]

#: Zstandard's sizes and 64-bit fingerprints of shingles aren't there in SQL; tests/llm/ has brute force for each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
