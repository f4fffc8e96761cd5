"""The append-only ledger: what is pending, done or dead is derived, never stored.

events(id, memory_id, enrichment_version, attempt, status, permanent, created_at, ...). One aggregate per memory and
version gives the flags that every state is a filter of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The exponent of the backoff stops here.
MOST_DOUBLINGS = 6


def _version(version: int) -> int:
    if version <= 0:
        raise ValueError("a version is above 0")
    return version


def done(events: DataFrame) -> DataFrame:
    return events.where("status = 'done'")


def latest_enrichment(events: DataFrame) -> DataFrame:
    """Of each memory's done events the one of the highest version, then id."""
    newest = Window.partitionBy("memory_id").orderBy(F.desc("enrichment_version"), F.desc("id"))
    return done(events).withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def enrichment_at_version(events: DataFrame, version: int) -> DataFrame:
    return done(events).where(F.col("enrichment_version") == _version(version))


def fetch_at_version(memories: DataFrame, events: DataFrame, version: int) -> DataFrame:
    """Each memory with its enrichment at the version; those without one aren't there, whatever older versions have."""
    found = enrichment_at_version(events, version).select("memory_id", *(c for c in events.columns if c not in {*memories.columns, "memory_id"}))
    return memories.join(found, memories["id"] == found["memory_id"]).drop("memory_id")


def flags(events: DataFrame, version: int) -> DataFrame:
    """memory_id, has_done, has_permanent, n_fail, last_fail at the version. The last failure is that of the highest
    attempt, then id, which needn't be the latest in time."""
    failed = F.col("status") == "failed"
    return (
        events.where(F.col("enrichment_version") == _version(version))
        .groupBy("memory_id")
        .agg(
            F.bool_or(F.col("status") == "done").alias("has_done"),
            F.bool_or(failed & F.col("permanent")).alias("has_permanent"),
            F.count_if(failed).alias("n_fail"),
            F.max_by(F.when(failed, F.col("created_at")), F.when(failed, F.struct("attempt", "id"))).alias("last_fail"),
        )
    )


def states(memories: DataFrame, events: DataFrame, version: int) -> DataFrame:
    """All memories with their flags, false and 0 for one that was never tried."""
    f = flags(events, version)
    rows = memories.join(f, memories["id"] == f["memory_id"], "left").drop("memory_id")
    return rows.withColumns({"has_done": F.coalesce("has_done", F.lit(False)), "has_permanent": F.coalesce("has_permanent", F.lit(False)), "n_fail": F.coalesce("n_fail", F.lit(0))})


def waited(as_of: Column, base_seconds: float) -> Column:
    """Whether the last failure is long enough ago; the wait doubles with each failure up to MOST_DOUBLINGS."""
    wait = F.pow(F.lit(2.0), F.least(F.col("n_fail"), F.lit(MOST_DOUBLINGS))) * base_seconds
    gone = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("last_fail").cast("timestamp"))) / 1e6
    return F.col("last_fail").isNull() | (gone > wait)


def pending(memories: DataFrame, events: DataFrame, version: int, as_of: Column, max_attempts: int = 5, base_seconds: float = 60.0) -> DataFrame:
    """Memories to enrich now: not done, no permanent failure, attempts left, and waited for long enough."""
    rows = states(memories, events, version)
    return rows.where(~F.col("has_done") & ~F.col("has_permanent") & (F.col("n_fail") < max_attempts) & waited(as_of, base_seconds)).select(*memories.columns)


def progress(memories: DataFrame, events: DataFrame, version: int, by: tuple[str, ...] = ("conversation_id",)) -> DataFrame:
    """total, done, remaining and dead, per conversation or, by nothing, over all. Dead are those with a permanent failure,
    done or not; the remaining include them."""
    counts = states(memories, events, version).groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if("has_done").alias("done"), F.count_if(~F.col("has_done")).alias("remaining"), F.count_if("has_permanent").alias("dead")
    )
    return counts


def is_dead(max_attempts: int) -> Column:
    return ~F.col("has_done") & (F.col("has_permanent") | (F.col("n_fail") >= max_attempts))


def dead_letter(memories: DataFrame, events: DataFrame, version: int, max_attempts: int = 5) -> DataFrame:
    """Memories that won't be tried again: not done, and failed for good or too often."""
    return states(memories, events, version).where(is_dead(max_attempts)).select(*memories.columns)


def plan_pages(todo: DataFrame, batch_size: int, batches: int, order: str = "id") -> DataFrame:
    """The first batch_size * batches rows in order, with page, from 0. The limit comes before the window, so no more rows
    than a sweep handles are ever in one task."""
    some = todo.orderBy(order).limit(batch_size * batches)
    return some.withColumn("page", F.floor((F.row_number().over(Window.orderBy(order)) - 1) / batch_size).cast("int"))


def contiguous_watermark(outcomes: DataFrame) -> DataFrame:
    """outcomes(batch, idx, outcome) to batch, watermark: how many from the start are over. Permanent failures are, others
    aren't."""
    open_ = F.col("outcome") == "failed"
    return outcomes.groupBy("batch").agg(F.coalesce(F.min(F.when(open_, F.col("idx"))), F.max("idx") + 1).alias("watermark"))


def batch_outcomes(outcomes: DataFrame) -> DataFrame:
    """done, failed and permanent per batch, and whether the batch as a whole has failed: some did and none is done."""
    n = lambda x: F.count_if(F.col("outcome") == x)
    return outcomes.groupBy("batch").agg(n("done").alias("done"), n("failed").alias("failed"), n("permanent").alias("permanent")).withColumn(
        "batch_failed", (F.col("failed") > 0) & (F.col("done") == 0)
    )


def first_done(existing: DataFrame, new: DataFrame) -> DataFrame:
    """The new done events that may be appended: the first of each memory and version, unless one is there already."""
    key = ["memory_id", "enrichment_version"]
    first = Window.partitionBy(*key).orderBy("id")
    rows = done(new).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return rows.join(done(existing).select(*key), key, "left_anti").select(*new.columns)


def appendable(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Of new events, the done ones as in first_done and all failures."""
    return first_done(existing, new).unionByName(new.where("status = 'failed'"))


def new_memories(existing: DataFrame, new: DataFrame, order: str = "pos") -> DataFrame:
    """Marks each new row with accepted: whether its key is new here and among those before it. An empty turn_id is none,
    and rows without one never count as repeated."""
    key = ["conversation_id", "session_id", "turn_id"]
    rows = new.withColumn("turn_id", F.nullif("turn_id", F.lit("")))
    first = F.row_number().over(Window.partitionBy(*key).orderBy(order)) == 1
    known = existing.select(*key).where("turn_id is not null").distinct().withColumn("_known", F.lit(True))
    # rows without a turn_id share a key here but not in the ledger; they go around the window
    named, unnamed = rows.where("turn_id is not null"), rows.where("turn_id is null")
    named = named.withColumn("_first", first).join(known, key, "left").withColumn("accepted", F.col("_first") & F.col("_known").isNull()).drop("_first", "_known")
    return named.unionByName(unnamed.withColumn("accepted", F.lit(True)))


def acknowledged(marked: DataFrame) -> DataFrame:
    return marked.agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("deduped"))


def by_ids(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """The memories whose id is among ids(id)."""
    return memories.join(ids.select("id").distinct(), "id", "left_semi").select(*memories.columns)


def strict_lookup(ids: DataFrame, refs: DataFrame) -> DataFrame:
    """ids(id, ...) with the columns of refs; an error when it's read if an id isn't there."""
    rows = ids.join(refs.withColumn("_there", F.lit(True)), "id", "left")
    missing = F.raise_error(F.concat(F.lit("no memory has the id "), F.col("id").cast("string")))
    return rows.withColumn("id", F.when(F.col("_there"), F.col("id")).otherwise(missing.cast(dict(ids.dtypes)["id"]))).drop("_there")


def with_twins(fetched: DataFrame, local: DataFrame, order: str = "pos") -> DataFrame:
    """fetched(content_hash, ...) with the local row of the same content; of several, the last in order."""
    last = Window.partitionBy("content_hash").orderBy(F.desc(order))
    twins = local.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", order)
    return fetched.join(twins, "content_hash")


def without_twins(fetched: DataFrame, local: DataFrame) -> DataFrame:
    return fetched.join(local.select("content_hash"), "content_hash", "left_anti")


def twins_report(fetched: DataFrame, local: DataFrame, some: int = 5) -> tuple[int, list[str]]:
    """How many fetched rows have no local twin, and the content hashes of the first few, for a message."""
    lost = without_twins(fetched, local)
    return lost.count(), [r["h"] for r in lost.select(F.lower(F.hex("content_hash")).alias("h")).orderBy("h").limit(some).collect()]


def is_pending(memories: DataFrame, events: DataFrame, version: int, as_of: Column, memory_id: int, **how: float) -> bool:
    return not pending(memories.where(F.col("id") == memory_id), events.where(F.col("memory_id") == memory_id), version, as_of, **how).isEmpty()
