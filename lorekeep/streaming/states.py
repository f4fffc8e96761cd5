"""The ledger's derived states kept up by streams: what is pending, as changes, and how far a batch is over without a gap."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from lorekeep.operators.ledger import MOST_DOUBLINGS

LOG = "memory_id long, id long, attempt int, status string, permanent boolean, at timestamp"
CHANGES = "memory_id long, micros long, seq int, pending boolean"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: States lie in so many buckets by key, one array each; a micro-batch takes all rows of a bucket in one step, and writes
#: anew the buckets that it meets. A checkpoint is bound to this number.
BUCKETS = 1024

#: What is kept of a memory; last_fail is only told if it has failed.
MEMORY = np.dtype([("memory", "i8"), ("id", "i8"), ("last_fail", "i8"), ("attempt", "i4"), ("n_fail", "i4"), ("seq", "i4"), ("known", "?"), ("closed", "?"), ("failed", "?"), ("pending", "?")])
_KNOWN, _DONE, _FAILED, _DEAD, _OTHER = range(5)
_NEVER = np.iinfo(np.int64).max
#: Times that pandas has.
_FIRST, _LAST = "1678-01-01", "2262-01-01"


def _bucket(key: str) -> Column:
    """Of a key that is null, -1."""
    return F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(BUCKETS))).cast("int")


def _arrays(frames: Iterable[pd.DataFrame], *columns: str) -> list[np.ndarray]:
    """The columns of a bucket's rows, whatever number of frames they come in."""
    parts = [[f[c].to_numpy(np.int64) for c in columns] for f in frames if len(f)]
    return [np.concatenate(x) for x in zip(*parts)] if parts else [np.empty(0, np.int64) for _ in columns]


def _ranks(first: np.ndarray) -> np.ndarray:
    """Each row's place in its group, from 0; first marks where groups begin."""
    at = np.arange(len(first))
    return at - np.maximum.accumulate(np.where(first, at, 0))


class Memories:
    """The memories of a bucket: their failures, and whether each is pending. Rows of many memories are taken at once, the first
    of each, then the second, and so on; changes come as arrays of memory, micros, seq and pending."""

    def __init__(self, held: bytes | None, max_attempts: int, base_seconds: float):
        self.s = np.frombuffer(held or b"", MEMORY).copy()
        self.max_attempts = max_attempts
        self.waits = np.array([int(2.0**n * base_seconds * 1e6) for n in range(MOST_DOUBLINGS + 1)], np.int64)
        self.told: list[tuple[np.ndarray, ...]] = []

    def due(self, s: np.ndarray) -> np.ndarray:
        """The microsecond from which each is pending, if nothing else happens; _NEVER: it won't be."""
        due = np.where(s["failed"], s["last_fail"] + self.waits[np.minimum(s["n_fail"], MOST_DOUBLINGS)] + 1, 0)
        return np.where(~s["known"] | s["closed"] | (s["n_fail"] >= self.max_attempts), _NEVER, due)

    def moved(self, at: np.ndarray, to: np.ndarray | int, since: np.ndarray | int) -> None:
        """Tells the changes of the memories at these places up to a time."""
        s = self.s[at]
        due = self.due(s)
        pending = due <= to
        new = pending != s["pending"]
        # a wait that was over before this event began is over at its own time
        micros = np.where(pending, np.maximum(due, since), to)[new]
        at, pending = at[new], pending[new]
        self.s["pending"][at] = pending
        self.s["seq"][at] += 1
        self.told.append((self.s["memory"][at], micros, self.s["seq"][at], pending))

    def take(self, memory: np.ndarray, micros: np.ndarray, id: np.ndarray, attempt: np.ndarray, kind: np.ndarray) -> None:
        added = np.setdiff1d(memory, self.s["memory"])
        new = np.zeros(len(added), MEMORY)
        new["memory"] = added
        self.s = np.concatenate([self.s, new])
        self.s = self.s[np.argsort(self.s["memory"], kind="stable")]
        order = np.lexsort((id, micros, memory))
        memory, micros, id, attempt, kind = (x[order] for x in (memory, micros, id, attempt, kind))
        place, rank = np.searchsorted(self.s["memory"], memory), _ranks(np.append(True, memory[1:] != memory[:-1])[: len(memory)])
        rounds = np.argsort(rank, kind="stable")
        for taken in np.split(rounds, np.cumsum(np.bincount(rank))[:-1]) if len(rank) else []:
            at, now, what = place[taken], micros[taken], kind[taken]
            since = np.where(rank[taken] > 0, micros[taken - 1], 0)
            self.moved(at, now - 1, since)  # until just before the event
            self.s["known"][at] |= what == _KNOWN
            self.s["closed"][at] |= (what == _DONE) | (what == _DEAD)
            fails = (what == _FAILED) | (what == _DEAD)
            rows, at = taken[fails], at[fails]
            self.s["n_fail"][at] += 1
            s = self.s[at]
            later = ~s["failed"] | (attempt[rows] > s["attempt"]) | (attempt[rows] == s["attempt"]) & (id[rows] > s["id"])
            rows, at = rows[later], at[later]
            self.s["attempt"][at], self.s["id"][at], self.s["last_fail"][at], self.s["failed"][at] = attempt[rows], id[rows], micros[rows], True
            self.moved(place[taken], now, now)

    def changes(self) -> list[np.ndarray]:
        return [np.concatenate(x) for x in zip(*self.told)]

    def next_due(self) -> int | None:
        """The first microsecond from which one that isn't pending is."""
        due = self.due(self.s)[~self.s["pending"]]
        first = int(due.min()) if len(due) else _NEVER
        return None if first == _NEVER else first



def with_rocks(spark: SparkSession, start):
    """start() under the state store that such operators need; a query keeps the one it was started with."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        return start()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def pending_changes(log: DataFrame, max_attempts: int = 5, base_seconds: float = 60.0, late: str = "0 seconds") -> DataFrame:
    """memory_id, micros, seq, pending: each change of whether a memory is pending, and the time from which it holds.

    log(memory_id, id, attempt, status, permanent, at) is a stream of the events of one version, in the order of their times
    up to `late`, and of a row with the status `memory` for each memory. Waits that end after the watermark are told when
    it gets there: each bucket has a timer for the first of them."""
    failed = F.when(F.col("permanent"), _DEAD).otherwise(_FAILED)
    kind = F.when(F.col("status") == "memory", _KNOWN).when(F.col("status") == "done", _DONE).when(F.col("status") == "failed", failed).otherwise(_OTHER)
    within = F.least(F.greatest("at", F.lit(_FIRST).cast("timestamp")), F.lit(_LAST).cast("timestamp"))
    rows = log.withColumns({"micros": F.unix_micros("at"), "at": within}).withWatermark("at", late)
    rows = rows.select(
        _bucket("memory_id").alias("bucket"), F.coalesce("memory_id", F.lit(0)).cast("long").alias("memory"), "micros", F.col("id").cast("long").alias("id"),
        F.coalesce("attempt", F.lit(np.iinfo(np.int32).min)).cast("int").alias("attempt"), kind.alias("kind"), "at",
    )

    def taken(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        m = Memories(state.get[0] if state.exists else None, max_attempts, base_seconds)
        m.take(*_arrays(frames, "memory", "micros", "id", "attempt", "kind"))
        watermark = max(state.getCurrentWatermarkMs(), 0)
        m.moved(np.flatnonzero(~m.s["pending"]), watermark * 1000, 0)
        state.update((m.s.tobytes(),))
        if (due := m.next_due()) is not None:  # a timer is over when the watermark is beyond it
            state.setTimeoutTimestamp(max(-(-due // 1000) - 1, watermark, 1))
        memory, micros, seq, pending = m.changes()
        memory = pd.array([None] * len(memory), "Int64") if key[0] < 0 else memory
        yield pd.DataFrame({"memory_id": memory, "micros": micros, "seq": seq, "pending": pending})

    return rows.groupBy("bucket").applyInPandasWithState(taken, CHANGES, "held binary", "append", "EventTimeTimeout")


def pending_at(changes: DataFrame, micros: int) -> DataFrame:
    """The memories that are pending at a time, from the changes until then."""
    last = F.max(F.col("seq").cast("long") * 2 + F.col("pending").cast("int"))  # times go up with seq
    return changes.where(F.col("micros") <= micros).groupBy("memory_id").agg((last % 2 == 1).alias("pending")).where("pending").select("memory_id")


PREFIX = np.dtype([("batch", "i8"), ("next", "i4")])
ITEM = np.dtype([("batch", "i8"), ("idx", "i4")])


def _prefixes(held: bytes | None, beyond: bytes | None, batch: np.ndarray, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A bucket's prefixes and the items over beyond them, with new items that are over; and the prefixes that rose."""
    s, b = np.frombuffer(held or b"", PREFIX), np.frombuffer(beyond or b"", ITEM)
    batch, idx = np.append(b["batch"], batch), np.append(b["idx"].astype(np.int64), idx)
    order = np.lexsort((idx, batch))
    batch, idx = batch[order], idx[order]
    once = np.append(True, (batch[1:] != batch[:-1]) | (idx[1:] != idx[:-1]))[: len(batch)]
    batch, idx = batch[once], idx[once]
    known = np.zeros(len(own := np.union1d(s["batch"], batch)), PREFIX)
    known["batch"] = own
    known["next"][np.searchsorted(own, s["batch"])] = s["next"]
    place = np.searchsorted(own, batch)
    ahead = idx >= known["next"][place]
    batch, idx, place = batch[ahead], idx[ahead], place[ahead]
    joins = idx == known["next"][place] + _ranks(np.append(True, place[1:] != place[:-1])[: len(place)])
    rose = np.bincount(place[joins], minlength=len(own)).astype(np.int32)
    known["next"] += rose
    left = np.zeros(int((~joins).sum()), ITEM)
    left["batch"], left["idx"] = batch[~joins], idx[~joins]
    return known[known["next"] > 0], left, known[rose > 0]


def prefix_changes(outcomes: DataFrame) -> DataFrame:
    """batch (a long), watermark: how many items from the start are over, whenever that rises. outcomes(batch, idx, outcome) is a
    stream in any order; a failed item may come again, and what is over twice counts once. Of each batch there is the first
    item that isn't over, and those over beyond it."""
    over = outcomes.where(F.coalesce(F.col("outcome") != "failed", F.lit(True)))
    rows = over.select(F.col("batch").cast("long").alias("batch"), F.col("idx").cast("int").alias("idx"))
    rows = rows.select(_bucket("batch").alias("bucket"), F.coalesce("batch", F.lit(0).cast("long")).alias("batch"), "idx")

    def taken(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, beyond, rose = _prefixes(*(state.get if state.exists else (None, None)), *_arrays(frames, "batch", "idx"))
        state.update((known.tobytes(), beyond.tobytes()))
        batch = pd.array([None] * len(rose), "Int64") if key[0] < 0 else rose["batch"]
        yield pd.DataFrame({"batch": batch, "watermark": rose["next"]})

    return rows.groupBy("bucket").applyInPandasWithState(taken, "batch long, watermark int", "known binary, beyond binary", "update", "NoTimeout")


def run_to_end(spark: SparkSession, rows: DataFrame, folder: str, mode: str) -> DataFrame:
    """Runs a stream over what its source has now, and returns what it has told."""
    writer = rows.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        started = lambda: writer.format("parquet").option("path", f"{folder}/out").start()
    else:  # a batch that runs again writes its own folder again
        started = lambda: writer.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{folder}/out/micro_batch={n}")).start()
    with_rocks(spark, started).awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/out").select(*rows.columns)


def reached(changes: DataFrame) -> DataFrame:
    """The last watermark of each batch."""
    return changes.groupBy("batch").agg(F.max("watermark").alias("watermark"))
