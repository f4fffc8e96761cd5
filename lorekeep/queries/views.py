"""The driver's tables as the engine's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorekeep.functions.text import STOPWORDS, lexemes
from lorekeep.operators.index import Index, stored_index
from lorekeep.storage import spread, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, conversation: Column | None = None) -> DataFrame:
    """Documents, of one conversation unless a column is given, with their texts' lexemes, not stemmed."""
    conversation = F.lit("all") if conversation is None else conversation
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return docs.select(F.col("doc_id").alias("id"), conversation.alias("conversation_id"), F.col("source").alias("session_id"), lexemes(F.col("text"), False).alias("lexemes"))


def corpus(spark: SparkSession, sf_dir: str, conversation: Column | None = None) -> DataFrame:
    """Documents, tokenized once."""
    return written(documents(spark, sf_dir, conversation))


def index(spark: SparkSession, sf_dir: str, scoped: bool = False, stemmed: bool = False) -> Index:
    """The stored index of the documents' table, of one conversation or of one for each source; built when first asked."""
    conversation = F.col("source") if scoped else None
    name = "by source" if scoped else "all"
    return stored_index(spark, table(spark, sf_dir, "documents"), name, lambda: documents(spark, sf_dir, conversation), stemmed)


def questions(spark: SparkSession, sf_dir: str, stemmed: bool = False) -> DataFrame:
    """Every benchmark item, with its whole text."""
    rows = table(spark, sf_dir, "benchmark")
    return rows.select(F.col("item_id").alias("query_id"), F.lit("all").alias("conversation_id"), "text", lexemes(F.col("text"), stemmed).alias("lexemes"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.lit("all").alias("conversation_id"), F.col("vec_id").alias("id"), "embedding", F.col("label").alias("session_id"))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set of searches: ids divisible by 50."""
    rows = vectors(spark, sf_dir).where(F.col("id") % 50 == 0)
    return rows.select(F.col("id").alias("query_id"), "conversation_id", "embedding", "session_id")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    conv, turn = F.col("conv_id").cast("string"), F.col("turn")
    return rows.select(
        conv.alias("conversation_id"),
        F.concat_ws("_", conv, F.floor(turn / 3)).alias("session_id"),
        F.concat_ws("_", conv, turn).alias("turn_id"),
        F.col("role").alias("speaker"),
        "text",
        F.lit("2023-05-02 10:15").alias("date_time"),
        turn.cast("int").alias("pos"),
    )


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    return rows.select(F.col("o_orderkey").cast("long").alias("id"), F.col("o_custkey").cast("string").alias("conversation_id"))


def by_order(spark: SparkSession, sf_dir: str) -> GroupedData:
    """Line items by order and number; an order's are dealt out together, once for all that is made of them by order."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_discount", "l_shipdate")
    return rows.repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber")


def least_flag_is_a() -> Column:
    """Of flags, without sorting rows as the least of strings does."""
    flag = F.col("l_returnflag")
    return F.max(flag == "A") & ~F.max(flag < "A")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as enrichment attempts; of done ones, the first of each memory and version."""
    rows = by_order(spark, sf_dir).agg(
        F.min("l_suppkey").alias("supp"), least_flag_is_a().alias("done"), F.max("l_discount").alias("discount"), F.min("l_shipdate").alias("shipped")
    )
    done = F.col("done")
    rows = rows.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("id"),
        F.col("l_orderkey").cast("long").alias("memory_id"),
        (F.col("supp") % 2 + 1).cast("int").alias("enrichment_version"),
        F.col("l_linenumber").cast("int").alias("attempt"),
        F.when(done, "done").otherwise("failed").alias("status"),
        (~done & (F.col("discount") >= 0.09)).alias("permanent"),
        F.col("shipped").cast("timestamp").alias("created_at"),
    )
    first = F.row_number().over(Window.partitionBy("memory_id", "enrichment_version", "status").orderBy("id"))
    return rows.withColumn("_n", first).where("status = 'failed' or _n = 1").drop("_n")


STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def words_sql(text: str) -> str:
    return rf"[x FOR x IN regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{N}}]+') IF x <> '' AND NOT list_contains({STOP_SQL}, x)]"


EVENTS_SQL = """
raw AS (
  SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS id, CAST(l_orderkey AS BIGINT) AS memory_id,
    CAST(min(l_suppkey) % 2 + 1 AS INT) AS enrichment_version, CAST(l_linenumber AS INT) AS attempt,
    CASE WHEN min(l_returnflag) = 'A' THEN 'done' ELSE 'failed' END AS status,
    min(l_returnflag) <> 'A' AND max(l_discount) >= 0.09 AS permanent, CAST(min(l_shipdate) AS TIMESTAMP) AS created_at
  FROM lineitem GROUP BY l_orderkey, l_linenumber
), events AS (
  SELECT * FROM raw WHERE status = 'failed' UNION ALL
  SELECT * FROM raw WHERE status = 'done' QUALIFY row_number() OVER (PARTITION BY memory_id, enrichment_version ORDER BY id) = 1
), memories AS (SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(o_custkey AS VARCHAR) AS conversation_id FROM orders)
"""
TURNS_SQL = """
turns AS (
  SELECT CAST(conv_id AS VARCHAR) AS conversation_id, conv_id || '_' || (turn // 3) AS session_id, conv_id || '_' || turn AS turn_id,
    role AS speaker, text, '2023-05-02 10:15' AS date_time, CAST(turn AS INT) AS pos FROM conversations
)
"""
