"""Uploads as a stream; the ledger's sink is one writer, in micro-batches."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorekeep import schemas
from lorekeep.functions import keys
from lorekeep.operators.ledger import new_memories, strict_lookup
from lorekeep.storage import file_system, is_written, new_folder, written

#: Memories are in so many folders by their conversation, and a batch reads those of its own conversations.
BUCKETS = 64
LEDGER = f"{schemas.MEMORIES}, pos int, bucket int"
#: Texts are in folders by the first two digits of their hash.
BLOBS = "s3_key string, body string, prefix string"
STAGED = "conversation_id string, session_id string, turn_id string, pos int, body string, content_hash binary, s3_key string, bucket int, at long"
BATCHES = "source string, batch long, first long, rows long"
#: The table of batches has a file for each; so many are made one.
MOST_FILES = 256


def stored(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A table that may have no rows yet."""
    store, path = file_system(spark, folder)
    return spark.read.schema(schema).parquet(folder) if store.exists(path) else spark.createDataFrame([], schema)


def _staged(batch: DataFrame, ledger: str, folder: str) -> int:
    """Writes what is new in the batch, in order, to a folder of its own; returns how many rows the batch has, counted with
    the folders that they are for."""
    body = keys.envelope(**{c: F.col(c) for c in keys.ENVELOPE})
    batch = written(batch)  # a stream's batch is made anew for each look at it
    rows = batch.withColumn("body", body).withColumn("content_hash", keys.content_hash(F.col("body")))
    place = F.pmod(F.xxhash64("conversation_id"), F.lit(BUCKETS)).cast("int")
    rows = rows.withColumns({"s3_key": keys.blob_key(F.col("content_hash")), "bucket": place})
    touched = {r["bucket"]: r["n"] for r in batch.groupBy(place.alias("bucket")).agg(F.count("*").alias("n")).collect()}
    known = stored(batch.sparkSession, f"{ledger}/memories", LEDGER).where(F.col("bucket").isin(list(touched)))
    order = ["conversation_id", "session_id", "pos"]
    new = new_memories(known, rows).where("accepted").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    new.select(*(c.split()[0] for c in STAGED.split(", "))).write.mode("overwrite").parquet(folder)
    return sum(touched.values())


def _numbered(rows: DataFrame, first: int) -> DataFrame:
    """Staged rows with their ids: from `first` on, without gaps, in the order they were staged in."""
    parts = rows.groupBy(F.shiftright("at", 33).alias("_part")).agg(F.count("*").alias("_n"), F.min("at").alias("_first"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    parts = parts.select("_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + first).alias("_before"))
    rows = rows.join(F.broadcast(parts), F.shiftright("at", 33) == F.col("_part"))
    return rows.withColumn("id", F.col("at") + F.col("_before")).drop("_part", "_before")


def _one_file(spark: SparkSession, folder: str, schema: str) -> None:
    """Makes many small files one. Rows may be there twice if that is broken off, which changes no minimum or maximum."""
    store, path = file_system(spark, folder)
    files = [f.getPath() for f in store.listStatus(path) if f.getPath().getName().startswith("part-")]
    if len(files) > MOST_FILES:
        spark.read.schema(schema).parquet(*[f.toString() for f in files]).distinct().coalesce(1).write.mode("append").parquet(folder)
        for f in files:
            store.delete(f, False)


def append(batch: DataFrame, ledger: str, source: str, number: int, bucket: str = "memories") -> dict[str, int]:
    """Appends what is new in batch `number` of a source, and returns how many of its rows are accepted and deduped.

    The new rows are staged first, then the batch gets its ids, which go on from the last batch's, and then whatever isn't
    there yet is appended: texts under their hashes, then the rows that name them, by their ids. So a batch that runs again,
    wherever it was broken off and whatever part of it is there, ends with every row once, those without a turn_id
    included. What a source staged is kept until the batch after the next, as a stream repeats its last batch alone; an
    older batch is known by its number and left as it is."""
    spark = batch.sparkSession
    own = f"{ledger}/staged/{hashlib.sha256(source.encode()).hexdigest()[:16]}"
    folder, batches = f"{own}/{number}", stored(spark, f"{ledger}/batches", BATCHES)
    row = batches.where((F.col("source") == source) & (F.col("batch") == number)).first()
    if row and not is_written(spark, folder):
        return {"accepted": 0, "deduped": batch.count()}
    again = is_written(spark, folder)
    total = batch.count() if again else _staged(batch, ledger, folder)
    staged = spark.read.schema(STAGED).parquet(folder)
    if row:
        first, n = row["first"], row["rows"]
    else:
        first, n = batches.agg(F.coalesce(F.max(F.col("first") + F.col("rows")), F.lit(1))).first()[0], staged.count()
        spark.createDataFrame([(source, number, first, n)], BATCHES).coalesce(1).write.mode("append").parquet(f"{ledger}/batches")
    rows = _numbered(staged, first).withColumn("prefix", F.substring("s3_key", 1, 2))
    prefixes = [r["prefix"] for r in rows.select("prefix").distinct().collect()]
    blobs = stored(spark, f"{ledger}/blobs", BLOBS).where(F.col("prefix").isin(prefixes)).select("s3_key")
    texts = rows.select("s3_key", "body", "prefix").dropDuplicates(["s3_key"]).join(blobs, "s3_key", "left_anti")
    texts.repartition("prefix").write.mode("append").partitionBy("prefix").parquet(f"{ledger}/blobs")
    there = stored(spark, f"{ledger}/memories", LEDGER).where(F.col("id").between(first, first + n - 1)).select("id")
    facts = {"s3_bucket": F.lit(bucket), "byte_size": F.octet_length("body").cast("int"), "created_at": F.current_timestamp()}
    names = [f.name for f in spark.createDataFrame([], LEDGER).schema.fields]
    new = rows.join(there, "id", "left_anti").withColumns(facts).select(names)
    new.repartition("bucket").sortWithinPartitions("bucket", "id").write.mode("append").partitionBy("bucket").parquet(f"{ledger}/memories")
    store, path = file_system(spark, own)
    for old in store.listStatus(path):
        if old.getPath().getName().isdigit() and int(old.getPath().getName()) < number - 1:
            store.delete(old.getPath(), True)
    _one_file(spark, f"{ledger}/batches", BATCHES)
    accepted = 0 if row else n
    return {"accepted": accepted, "deduped": total - accepted}


def once_within(source: DataFrame, sent: str, within: str = "1 hour") -> DataFrame:
    """A stream of uploads without those repeated within so long of their time `sent`, by watermark: what it keeps of a row is
    forgotten after that, so its state doesn't grow with the stream. Rows without a turn_id never count as repeated. What
    comes again later is left to the ledger, which has every row once. As with any watermark, rows that are later than the
    bound are left out: `sent` is to be the time at which a row came in, or the bound as long as rows can be late."""
    rows = source.withColumn("turn_id", F.nullif("turn_id", F.lit(""))).withWatermark(sent, within)
    named = rows.where("turn_id is not null").dropDuplicatesWithinWatermark(["conversation_id", "session_id", "turn_id"])
    return named.unionByName(rows.where("turn_id is null"))


def ingest(source: DataFrame, ledger: str, checkpoint: str, sent: str | None = None, within: str = "1 hour"):
    """Starts a query that takes what the streaming source has now and ends; its batches are deduplicated in themselves and
    against the ledger and, if a column has the time each row was sent, within that time before they come to it."""
    rows = once_within(source, sent, within) if sent else source
    started = rows.writeStream.foreachBatch(lambda batch, number: append(batch, ledger, checkpoint, number) and None)
    return started.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def texts_of(spark: SparkSession, ledger: str, memories: DataFrame) -> DataFrame:
    """id, speaker, text and date_time of memories, from the stored texts; an error when it's read if one isn't there."""
    refs = stored(spark, f"{ledger}/blobs", BLOBS).withColumnRenamed("s3_key", "id")
    found = strict_lookup(memories.select(F.col("s3_key").alias("id"), F.col("id").alias("memory_id")), refs)
    parsed = keys.parse_envelope(F.col("body"))
    return found.select(F.col("memory_id").alias("id"), *(F.coalesce(parsed[c], F.lit("")).alias(c) for c in ("speaker", "text", "date_time")), "id").toDF("id", "speaker", "text", "date_time", "s3_key")


def ingested(source: DataFrame, ledger: str | None = None, sent: str | None = None, within: str = "1 hour") -> DataFrame:
    """Runs ingest to its end and returns the ledger's memories."""
    spark = source.sparkSession
    ledger = ledger or new_folder(spark)
    ingest(source, ledger, f"{ledger}/checkpoint", sent, within).awaitTermination()
    return stored(spark, f"{ledger}/memories", LEDGER)


def throughput(events: DataFrame, size: str = "1 hour", late: str | None = "10 minutes") -> DataFrame:
    """Events per window of their time and kind, for batch or stream; an extra of this engine. Events without a time are of
    a window without a start. A stream's windows can be appended once they are closed, and are forgotten then; without
    `late` none is ever closed or too late, so that complete mode has them all."""
    dated = events.select(F.coalesce("ts", F.lit(0).cast("timestamp")).alias("ts"), "event_type", F.col("ts").isNull().alias("undated"))
    rows = dated.withWatermark("ts", late) if dated.isStreaming and late else dated
    counts = rows.groupBy(F.window("ts", size).alias("w"), "undated", "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.when(~F.col("undated"), F.col("w.start")).alias("start"), "event_type", "n")
