import random

from pyspark.sql import functions as F

from lorekeep.operators import ledger as L
from lorekeep.streaming import views

KIND = "id long, memory_id long, enrichment_version int, attempt int, status string, permanent boolean, created_at timestamp"


def test_views_equal_the_recomputed_states_after_each_batch(spark, tmp_path):
    """New events alone are read, and only the parts that they change are written."""
    rnd = random.Random(2)
    folder, given, memories = f"file://{tmp_path}/view", [], spark.createDataFrame([(i, f"c{i % 3}") for i in range(40)], "id long, conversation_id string")
    at = F.timestamp_seconds(F.lit(1_700_000_000))
    stream = lambda: spark.readStream.schema(spark.createDataFrame([], KIND).schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    before = {}
    for k, n in enumerate((60, 50, 2, 0, 1)):
        own = []
        for i in range(n):
            status = rnd.choice(["done", "failed", "failed"])
            own.append((1000 * k + i, rnd.randrange(40), rnd.randint(1, 3), rnd.randint(1, 5), status, status == "failed" and rnd.random() < 0.1))
        given += own
        events = lambda rows: spark.createDataFrame(rows, KIND.rpartition(",")[0]).withColumn("created_at", at + F.make_interval(secs=F.col("id")))
        events(own).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        query = views.keep(stream(), folder)
        query.awaitTermination()
        assert sum(p["numInputRows"] for p in query.recentProgress) == n
        every, flags = events(given), views.view(spark, folder)
        key = lambda df: sorted(map(tuple, df.collect()), key=str)
        assert key(views.latest(flags)) == key(L.latest_enrichment(every).select("memory_id", "id", "enrichment_version", "attempt"))
        for version in (1, 2, 4):
            assert key(views.progress(memories, flags, version)) == key(L.progress(memories, every, version))
            want = L.flags(every, version)
            assert key(flags.where(F.col("enrichment_version") == version).select(*want.columns)) == key(want)
        parts = views.parts_of(spark, folder, views.versions(spark, folder)[0])
        changed = [p for p in parts if before.get(p) != parts[p]]
        assert len(changed) <= n and (n or parts == before)
        before = parts
    assert len(views.versions(spark, folder)) <= 2
    last = views.versions(spark, folder)[0]
    same = sorted(map(str, views.view(spark, folder).collect()))
    again = views.flags_of(events(given)).where((F.col("memory_id") == given[-1][1]) & (F.col("enrichment_version") == given[-1][2]))
    views.merge(again, folder, last)  # the last batch runs again
    assert sorted(map(str, views.view(spark, folder).collect())) == same


def test_a_view_that_is_not_there_is_empty(spark, tmp_path):
    assert views.view(spark, f"file://{tmp_path}/none").isEmpty()


def test_the_view_is_the_only_state(spark, tmp_path):
    """The stream holds no state of its own; a batch goes on from the view, and one that runs again changes nothing."""
    folder = f"file://{tmp_path}/view"
    rows = [
        [(1, 7, 1, 3, "failed", False), (2, 7, 1, 1, "done", False), (3, 8, 1, 1, "failed", True), (4, 9, 2, None, "failed", None)],
        [(5, 7, 1, 2, "failed", False), (6, 8, 1, 2, "failed", False), (7, 7, 1, 9, "done", False), (8, 9, 2, 1, "done", None)],
    ]
    events = lambda rows: spark.createDataFrame(rows, KIND.rpartition(",")[0]).withColumn("created_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")))
    for k, own in enumerate(rows):
        events(own).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema(spark.createDataFrame([], KIND).schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        query = views.keep(stream, folder)
        query.awaitTermination()
        assert not any(p["stateOperators"] for p in query.recentProgress)
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    for _ in range(2):
        flags, every = views.view(spark, folder), events(rows[0] + rows[1])
        for version in (1, 2):
            want = L.flags(every, version)
            assert key(flags.where(F.col("enrichment_version") == version).select(*want.columns)) == key(want)
        assert key(views.latest(flags)) == key(L.latest_enrichment(every).select("memory_id", "id", "enrichment_version", "attempt"))
        views.advance(events(rows[1]), folder, views.versions(spark, folder)[0])
