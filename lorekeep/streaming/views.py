"""Derived states as tables that a stream of events keeps up: what changes is merged, and old events are not read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.storage import file_system, is_written, written

#: The view is in so many parts by memory; a batch writes anew those that it changes. A folder is bound to this number.
PARTS = 64
KEY = ["memory_id", "enrichment_version"]
FLAGS = (
    "memory_id long, enrichment_version int, has_done boolean, has_permanent boolean, n_fail long, last_fail timestamp, "
    "fail_attempt int, fail_id long, done_id long, done_attempt int, part int"
)
MANIFEST = "part int, version long"


def _part() -> Column:
    return F.pmod(F.xxhash64("memory_id"), F.lit(PARTS)).cast("int").alias("part")


def _states(rows: DataFrame, n_fail: Column, failed: Column, done: Column) -> DataFrame:
    """The state of each memory and version; failed and done are structs that begin with what the last one goes by."""
    states = rows.groupBy("part", *KEY).agg(F.max("has_done").alias("has_done"), F.max("has_permanent").alias("has_permanent"), n_fail.alias("n_fail"), F.max(failed).alias("f"), F.max(done).alias("d"))
    told = ("f.last_fail", "f.fail_attempt", "f.fail_id", "d.done_id", "d.done_attempt")
    return states.select(*KEY, "has_done", "has_permanent", "n_fail", *told, "part")


def flags_of(events: DataFrame) -> DataFrame:
    """The state of each memory and version after these events alone."""
    done, failed = F.col("status") == "done", F.col("status") == "failed"
    rows = events.withColumns({"enrichment_version": F.col("enrichment_version").cast("int"), "has_done": done, "has_permanent": failed & F.col("permanent"), "part": _part()})
    last_fail = F.struct(F.col("attempt").alias("fail_attempt"), F.col("id").alias("fail_id"), F.col("created_at").alias("last_fail"))
    last_done = F.struct(F.col("id").alias("done_id"), F.col("attempt").alias("done_attempt"))
    return _states(rows.repartition("part"), F.count_if(failed), F.when(failed, last_fail), F.when(done, last_done))


def gone_on(old: DataFrame, new: DataFrame) -> DataFrame:
    """States that go on from old ones by those of new events."""
    rows = old.unionByName(new).repartition("part")
    return _states(rows, F.sum("n_fail"), F.when(F.col("n_fail") > 0, F.struct("fail_attempt", "fail_id", "last_fail")), F.when(F.col("has_done"), F.struct("done_id", "done_attempt")))


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The versions that are written to their end, the last one first."""
    store, path = file_system(spark, f"{folder}/manifest")
    found = [f.getPath().getName() for f in store.listStatus(path)] if store.exists(path) else []
    return sorted((int(n) for n in found if n.isdigit() and is_written(spark, f"{folder}/manifest/{n}")), reverse=True)


def parts_of(spark: SparkSession, folder: str, version: int) -> dict[int, int]:
    """In which version each part of a version was written."""
    return {r["part"]: r["version"] for r in spark.read.schema(MANIFEST).parquet(f"{folder}/manifest/{version}").collect()}


def _read(spark: SparkSession, folder: str, parts: dict[int, int]) -> DataFrame:
    paths = [f"{folder}/parts/version={v}/part={p}" for p, v in parts.items()]
    kind = FLAGS.rpartition(",")[0]
    return spark.read.option("basePath", f"{folder}/parts").schema(kind).parquet(*paths).drop("version", "part") if paths else spark.createDataFrame([], kind)


def view(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The table as of a version, the last unless told otherwise. Readers keep what they have begun to read for as long as
    a later version but one isn't there."""
    there = versions(spark, folder)
    version = version if version is not None else next(iter(there), None)
    return _read(spark, folder, parts_of(spark, folder, version) if version is not None else {})


def _before(spark: SparkSession, folder: str, version: int) -> dict[int, int]:
    """The parts of the version before this one."""
    before = next((v for v in versions(spark, folder) if v < version), None)
    return parts_of(spark, folder, before) if before is not None else {}


def _touched(changed: DataFrame, folder: str, parts: dict[int, int]) -> DataFrame:
    """The view's rows in the parts that have changed rows."""
    touched = {r["part"] for r in changed.select("part").distinct().collect()}
    return _read(changed.sparkSession, folder, {p: v for p, v in parts.items() if p in touched}).withColumn("part", _part())


def _put(rows: DataFrame, folder: str, version: int, parts: dict[int, int]) -> None:
    """Writes a version: rows as whole parts in place of the old ones, then the list of all parts."""
    spark, path = rows.sparkSession, f"{folder}/parts/version={version}"
    rows.write.mode("overwrite").partitionBy("part").parquet(path)
    store, where = file_system(spark, path)
    names = [f.getPath().getName() for f in store.listStatus(where)]
    parts = parts | {int(n[5:]): version for n in names if n.startswith("part=")}
    spark.createDataFrame(sorted(parts.items()), MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/{version}")
    _drop_old(spark, folder)


def merge(changed: DataFrame, folder: str, version: int) -> None:
    """Writes a version in which changed rows stand in place of the old ones of their keys, so one that is written again is the same."""
    parts = _before(changed.sparkSession, folder, version)
    changed = written(changed)  # a batch is made anew for each look at it
    kept = _touched(changed, folder, parts).join(changed.select(*KEY), KEY, "left_anti")
    _put(kept.unionByName(changed).repartition("part"), folder, version, parts)


def advance(events: DataFrame, folder: str, version: int) -> None:
    """Writes a version that goes on from the one before by new events; so one that is written again is the same."""
    parts, new = _before(events.sparkSession, folder, version), flags_of(events)
    if parts:
        new = written(new)  # a stream's batch is made anew for each look at it
        new = gone_on(_touched(new, folder, parts), new)
    _put(new, folder, version, parts)


def _drop_old(spark: SparkSession, folder: str, kept: int = 2) -> None:
    """Parts and lists that the last versions don't name."""
    last = versions(spark, folder)[:kept]
    named = {(p, v) for version in last for p, v in parts_of(spark, folder, version).items()}
    store, path = file_system(spark, f"{folder}/parts")
    for of in store.listStatus(path) if store.exists(path) else []:
        version = int(of.getPath().getName().partition("=")[2])
        for part in store.listStatus(of.getPath()):
            name = part.getPath().getName()
            if name.startswith("part=") and version <= last[0] and (int(name[5:]), version) not in named:
                store.delete(part.getPath(), True)
    for old in versions(spark, folder)[kept:]:
        store.delete(file_system(spark, f"{folder}/manifest/{old}")[1], True)


def keep(events: DataFrame, folder: str):
    """Starts a query that takes what a stream of events has now into the view, and ends. The view itself is the state that it goes
    on from, so a batch reads its new events and the parts of the view that they change, and no executor holds states."""
    started = events.writeStream.outputMode("append").foreachBatch(lambda batch, number: advance(batch, folder, number))
    return started.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def latest(flags: DataFrame) -> DataFrame:
    """memory_id, id, enrichment_version and attempt of each memory's done event of the highest version."""
    rows = flags.where("has_done").groupBy("memory_id").agg(F.max(F.struct("enrichment_version", "done_id", "done_attempt")).alias("x"))
    return rows.select("memory_id", F.col("x.done_id").alias("id"), "x.enrichment_version", F.col("x.done_attempt").alias("attempt"))


def progress(memories: DataFrame, flags: DataFrame, version: int) -> DataFrame:
    """total, done, remaining and dead of each conversation, as ledger.progress has them of the events."""
    own = flags.where(F.col("enrichment_version") == version).select("memory_id", "has_done", "has_permanent")
    rows = memories.join(own, memories["id"] == own["memory_id"], "left")
    done, dead = F.coalesce("has_done", F.lit(False)), F.coalesce("has_permanent", F.lit(False))
    return rows.groupBy("conversation_id").agg(F.count("*").alias("total"), F.count_if(done).alias("done"), F.count_if(~done).alias("remaining"), F.count_if(dead).alias("dead"))
