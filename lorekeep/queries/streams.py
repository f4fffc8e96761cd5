"""Streams over the driver's tables, run to their end and read back."""

from __future__ import annotations

from datetime import datetime
from functools import partial

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorekeep.config import Enrichment
from lorekeep.functions import keys
from lorekeep.operators import ledger as L
from lorekeep.operators.embed import MockEmbedder
from lorekeep.storage import new_folder, written
from lorekeep.streaming.ingest import append, ingested, stored, texts_of, throughput, LEDGER
from lorekeep.streaming import states, views
from lorekeep.streaming.sweep import Sweeper

from .ledger import AS_OF, SQL as LEDGER_SQL, WAIT, outcomes
from .views import TURNS_SQL, events, memories, turns, words_sql


def _stream(spark, d, name):
    """The table as a stream of files."""
    path = f"{d}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("recursiveFileLookup", "true").parquet(path)


def stream_ingest_dedup(spark, d):
    """All turns, those of odd conversations twice; the ledger has each once."""
    rows = _stream(spark, d, "conversations")
    conv = F.col("conv_id").cast("string")
    uploads = rows.withColumn("copy", F.explode(F.when(F.col("conv_id") % 2 == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    uploads = uploads.select(
        conv.alias("conversation_id"), F.concat_ws("_", conv, F.floor(F.col("turn") / 3)).alias("session_id"), F.concat_ws("_", conv, "turn").alias("turn_id"),
        F.col("role").alias("speaker"), "text", F.lit("2023-05-02 10:15").alias("date_time"), (F.col("turn") * 2 + F.col("copy")).cast("int").alias("pos"),
    )
    return ingested(uploads).select("turn_id", "session_id", "pos")


def upload_fetch_roundtrip(spark, d):
    """All turns uploaded, the same batch a second time, and those of even conversations in a later one; then the texts are
    read back from where they are stored, enriched in one sweep, fetched at the version, and met with the local turns."""
    folder, rows = new_folder(spark), turns(spark, d)
    again = rows.where(F.col("conversation_id").cast("bigint") % 2 == 0)
    for number, batch in ((0, rows), (0, rows), (1, again)):
        append(batch, folder, "upload", number)
    kept = stored(spark, f"{folder}/memories", LEDGER)
    config = Enrichment(version=3, dims=4, batches=0)
    sweeper = Sweeper(spark, folder, kept, texts_of(spark, folder, kept), partial(MockEmbedder, config.dims), config)
    sweeper.wave(F.current_timestamp())
    fetched = L.fetch_at_version(kept, sweeper.events(), config.version).drop("turn_id")
    local = rows.select(keys.content_hash(keys.envelope(**{c: F.col(c) for c in keys.ENVELOPE})).alias("content_hash"), "turn_id", "pos")
    return L.with_twins(fetched, local).select("turn_id", "conversation_id", F.size("lexemes").alias("n"), F.octet_length("embedding").alias("bytes"), F.date_format("ts", "yyyy-MM-dd").alias("said"))


def stream_dedup_within(spark, d):
    """All turns, sent in the order of their conversations; every third is sent again after 20 minutes, within the bound, and
    every fifth after a day, when the stream has forgotten it and the ledger has not. Each is there once; of what is sent twice any copy may be the one."""
    folder, rows = new_folder(spark), turns(spark, d)
    number = F.col("conversation_id").cast("bigint") * 16 + F.col("pos")
    first = rows.withColumn("sent", F.timestamp_seconds(1_700_000_000 + number * 60))
    again = [first.where(number % every == 0).withColumns({"sent": F.col("sent") + F.expr(f"interval {late}"), "pos": F.col("pos") + 1000}) for every, late in ((3, "20 minutes"), (5, "1 day"))]
    stream = _in_slices(spark, first.unionByName(again[0]).unionByName(again[1]), "sent", f"{folder}/sent", 3)
    return ingested(stream, f"{folder}/ledger", "sent").select("turn_id", "session_id", (F.col("pos") % 1000).alias("pos"))


def stream_throughput(spark, d):
    """Events per hour and kind through a stream: all windows, also those that a watermark wouldn't have closed at its end.
    Each batch writes the whole result anew, a row for each hour and kind; the last one's is it."""
    folder, numbers = new_folder(spark), []
    rows = throughput(_stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), late=None)

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/out/{number}")
        numbers.append(number)

    started = rows.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint")
    started.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/out/{numbers[-1]}").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


def _in_slices(spark, rows, by, folder, n=2):
    """The rows as a stream of n batches in the order of a time, each written after the one before."""
    rows = written(rows)
    low, high = rows.agg(F.min(F.unix_timestamp(by)), F.max(F.unix_timestamp(by))).first()
    part = F.floor((F.unix_timestamp(by) - (low or 0)) * n / ((high or 0) - (low or 0) + 1))
    files = max(4, spark.sparkContext.defaultParallelism)
    for i in range(n):
        rows.where(part == i).coalesce(files).write.mode("append").parquet(f"{folder}/{i}")
    return spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files).parquet(folder)


def stream_pending(spark, d):
    """Events and memories as a log, in the order of their times; what is pending at a time, from the changes told."""
    folder = new_folder(spark)
    known = memories(spark, d).select(F.col("id").alias("memory_id"), F.lit(0).cast("long").alias("id"), F.lit(None).cast("int").alias("attempt"), F.lit("memory").alias("status"), F.lit(False).alias("permanent"), F.lit("1990-01-01").cast("timestamp").alias("at"))
    log = events(spark, d).where("enrichment_version = 1").select("memory_id", "id", "attempt", "status", "permanent", F.col("created_at").alias("at"))
    stream = _in_slices(spark, known.unionByName(log), "at", f"{folder}/log")
    changes = states.run_to_end(spark, states.pending_changes(stream, 5, WAIT), folder, "append")
    at = int(datetime.fromisoformat(f"{AS_OF}+00:00").timestamp()) * 1_000_000
    return states.pending_at(changes, at).withColumnRenamed("memory_id", "id")


def stream_watermarks(spark, d):
    """How far each order is over: of its items, numbered without gaps, as a stream in any order."""
    folder, place = new_folder(spark), F.row_number().over(Window.partitionBy("batch").orderBy("idx")) - 1
    rows = outcomes(spark, d).withColumn("idx", place)
    rows.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
    told = states.run_to_end(spark, states.prefix_changes(stream), folder, "update")
    none = spark.read.schema(rows.schema).parquet(f"{folder}/in").select("batch", F.lit(0).alias("watermark"))
    return states.reached(none.union(told))


def _kept(spark, d):
    """The view of all events, after a stream in the order of their times."""
    folder = new_folder(spark)
    stream = _in_slices(spark, events(spark, d), "created_at", f"{folder}/in")
    views.keep(stream, f"{folder}/view").awaitTermination()
    return views.view(spark, f"{folder}/view")


def stream_latest(spark, d):
    return views.latest(_kept(spark, d))


def stream_progress(spark, d):
    return views.progress(memories(spark, d), _kept(spark, d), 1)


QUERIES = {f.__name__: f for f in (stream_dedup_within, stream_ingest_dedup, stream_latest, stream_pending, stream_progress, stream_throughput, stream_watermarks, upload_fetch_roundtrip)}
SQL = {
    "stream_ingest_dedup": f"WITH {TURNS_SQL} SELECT turn_id, session_id, CAST(pos * 2 AS INT) AS pos FROM turns",
    "upload_fetch_roundtrip": f"""WITH {TURNS_SQL} SELECT turn_id, conversation_id, said[1:10] AS said, 16 AS bytes,
  CAST(len({words_sql("'[2023-05-02] ' || CASE WHEN coalesce(speaker, '') <> '' THEN speaker || ': ' ELSE '' END || coalesce(text, '')")}) AS INT) AS n FROM (SELECT *, date_time AS said FROM turns)""",
    "stream_dedup_within": f"WITH {TURNS_SQL} SELECT turn_id, session_id, pos FROM turns",
    "stream_pending": LEDGER_SQL["ledger_pending"].replace("WHERE enrichment_version = 1", f"WHERE enrichment_version = 1 AND created_at <= TIMESTAMP '{AS_OF}'").replace("SELECT * FROM p", "SELECT id FROM p"),
    "stream_latest": LEDGER_SQL["ledger_latest"],
    "stream_progress": LEDGER_SQL["ledger_progress"],
    "stream_watermarks": LEDGER_SQL["contiguous_watermark"].replace("FROM o ", "FROM (SELECT batch, CAST(row_number() OVER (PARTITION BY batch ORDER BY idx) - 1 AS INT) AS idx, outcome FROM o) "),
    "stream_throughput": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
}
