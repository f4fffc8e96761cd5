"""Sweeps: take what is pending, enrich it in pages, append the outcomes; until nothing is left or time is up."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep import schemas
from lorekeep.config import Enrichment
from lorekeep.operators import embed as E
from lorekeep.operators import ledger as L
from lorekeep.plans.enrichment import as_events, enriched
from lorekeep.storage import written

from .ingest import stored


class Sweeper:
    """A single writer over the folders events/ and cache/ of a ledger.

    texts(id, speaker, text, date_time) has a row for each memory; a text that isn't there is a failure of that memory."""

    def __init__(self, spark: SparkSession, ledger: str, memories: DataFrame, texts: DataFrame, embedder: Callable[[], E.Embedder], config: Enrichment = Enrichment()):
        self.spark, self.ledger, self.memories, self.texts, self.embedder, self.config = spark, ledger, memories, texts, embedder, config

    def events(self) -> DataFrame:
        return stored(self.spark, f"{self.ledger}/events", schemas.EVENTS)

    def cache(self) -> DataFrame:
        return stored(self.spark, f"{self.ledger}/cache", schemas.CACHE)

    def backlog(self, as_of: Column) -> DataFrame:
        c = self.config
        return L.pending(self.memories, self.events(), c.version, as_of, c.max_attempts, c.backoff_seconds)

    def wave(self, as_of: Column, attempt: int = 1) -> dict[str, int]:
        """One round of pages, or of the whole backlog if the number of batches isn't above 0; what has failed or is done is
        appended. Returns the outcomes' counts."""
        c = self.config
        if c.batches > 0:
            pages = written(L.plan_pages(self.backlog(as_of), c.batch_size, c.batches).select("id", "page"))
            rows = pages.join(self.texts, "id", "left").repartition(c.batches, "page")
        else:
            rows = written(self.backlog(as_of).select("id")).join(self.texts, "id", "left")
        lost = rows.where("text is null").select("id", F.lit("failed").alias("status"), F.lit(False).alias("permanent"), F.lit("its text isn't there").alias("error_message"))
        found = enriched(rows.where("text is not null"), self.cache(), self.embedder, c.document_prefix, c.model, c.dims)
        done = written(found.unionByName(lost, allowMissingColumns=True))
        E.cacheable(done, self.cache(), c.document_prefix, c.model, c.dims, as_of).write.mode("append").parquet(f"{self.ledger}/cache")
        # a version's events are in a folder of their own
        old = self.events().where(F.col("enrichment_version") == c.version)
        last = self.events().agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        new = as_events(done, c.version, attempt, as_of).withColumn("id", F.monotonically_increasing_id() + F.lit(last + 1))
        named = [f.name for f in old.schema.fields]
        L.appendable(old, new.select(*(F.col(n).cast(old.schema[n].dataType).alias(n) for n in named))).write.mode("append").partitionBy("enrichment_version").parquet(f"{self.ledger}/events")
        kind = F.when(F.col("status") == "done", "done").when(F.col("permanent"), "permanent").otherwise("failed")
        return {r["kind"]: r["n"] for r in done.groupBy(kind.alias("kind")).agg(F.count("*").alias("n")).collect()}

    def run(self, as_of: Callable[[], Column] = F.current_timestamp, seconds: float = 50.0, pause: float = 1.0, most: int = 1000) -> list[dict[str, int]]:
        """Waves until a wave finds nothing, the time is up, or `most` have run. A wave that fails altogether is counted as
        such and doesn't end the sweep."""
        began, waves = time.monotonic(), []
        while len(waves) < most and time.monotonic() - began < seconds and not self.backlog(as_of()).isEmpty():
            waves.append(self.wave(as_of(), len(waves) + 1))
            time.sleep(pause)
        return waves


def wait_enriched(sweeper: Sweeper, seconds: float = 600.0, poll: float = 2.0) -> bool:
    """Polls until all memories are done; an error as soon as one is dead."""
    began = time.monotonic()
    while time.monotonic() - began < seconds:
        row = L.progress(sweeper.memories, sweeper.events(), sweeper.config.version, ()).first()
        if row["dead"]:
            raise RuntimeError(f"{row['dead']} memories have failed for good")
        if row["total"] > 0 and row["remaining"] == 0:
            return True
        time.sleep(poll)
    return False
