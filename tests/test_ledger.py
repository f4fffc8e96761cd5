import pytest
from pyspark.sql import functions as F

from lorekeep.operators import ledger as L

EVENTS = "id long, memory_id long, enrichment_version int, attempt int, status string, permanent boolean, created_at timestamp"


@pytest.fixture
def memories(spark):
    return spark.createDataFrame([(i, "c" if i < 6 else "d") for i in range(1, 8)], "id long, conversation_id string")


@pytest.fixture
def events(spark):
    rows = [
        (1, 1, 1, 1, "done", False, "2024-01-01"), (2, 1, 2, 1, "done", False, "2024-01-02"),
        (3, 2, 1, 5, "failed", False, "2024-01-01"), (4, 2, 1, 1, "failed", False, "2024-01-10"),
        (5, 3, 1, 1, "failed", True, "2024-01-01"), (6, 4, 1, 1, "failed", True, "2024-01-01"), (7, 4, 1, 2, "done", False, "2024-01-02"),
        *((10 + k, 5, 1, k, "failed", False, "2024-01-01") for k in range(5)),
    ]
    return spark.createDataFrame([(*r[:6], r[6]) for r in rows], EVENTS.replace("timestamp", "string")).withColumn("created_at", F.col("created_at").cast("timestamp"))


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_states(memories, events):
    at = F.lit("2024-01-05").cast("timestamp")
    assert ids(L.pending(memories, events, 1, at)) == [2, 6, 7]
    assert ids(L.pending(memories, events, 2, at)) == [2, 3, 4, 5, 6, 7]
    assert ids(L.dead_letter(memories, events, 1)) == [3, 5]
    rows = {r.conversation_id: r for r in L.progress(memories, events, 1).collect()}
    assert (rows["c"].total, rows["c"].done, rows["c"].remaining, rows["c"].dead) == (5, 2, 3, 2)
    assert L.progress(memories, events, 1, ()).first().total == 7


def test_backoff_goes_by_the_highest_attempt(memories, events):
    # attempt 5 failed on January 1st; the later attempt 1 doesn't count. Two failures: 4 times the base
    at = lambda day: F.lit(day).cast("timestamp")
    assert 2 not in ids(L.pending(memories, events, 1, at("2024-01-05"), base_seconds=86400.0))
    assert 2 in ids(L.pending(memories, events, 1, at("2024-01-05 00:00:01"), base_seconds=86400.0))


def test_versions(memories, events):
    assert [(r.memory_id, r.enrichment_version) for r in L.latest_enrichment(events).orderBy("memory_id").collect()] == [(1, 2), (4, 1)]
    assert ids(L.fetch_at_version(memories, events, 2).select(F.col("id"))) == [1]
    with pytest.raises(ValueError):
        L.enrichment_at_version(events, 0)


def test_the_first_done_stays_and_failures_all_do(spark, events):
    new = [(20, 1, 1, 1, "done", False), (21, 6, 1, 1, "done", False), (22, 6, 1, 2, "done", False), (23, 6, 1, 1, "failed", False), (24, 6, 1, 1, "failed", False)]
    new = spark.createDataFrame([(*r, None) for r in new], EVENTS)
    assert ids(L.appendable(events, new)) == [21, 23, 24]


def test_pages(spark):
    todo = spark.range(300).select("id")
    sizes = sorted(r["count"] for r in L.plan_pages(todo, 128, 8).groupBy("page").count().collect())
    assert sizes == [44, 128, 128] and L.plan_pages(todo, 10, 2).count() == 20


def test_outcomes(spark):
    rows = [(1, 0, "done"), (1, 1, "permanent"), (1, 2, "failed"), (1, 3, "done"), (2, 0, "failed"), (3, 0, "done")]
    df = spark.createDataFrame(rows, "batch int, idx int, outcome string")
    assert {r.batch: r.watermark for r in L.contiguous_watermark(df).collect()} == {1: 2, 2: 0, 3: 1}
    assert {r.batch: r.batch_failed for r in L.batch_outcomes(df).collect()} == {1: False, 2: True, 3: False}


def test_new_memories(spark):
    kind = "conversation_id string, session_id string, turn_id string, pos int"
    old = spark.createDataFrame([("c", "s", "t1", 0), ("c", "s", None, 1)], kind)
    new = spark.createDataFrame([("c", "s", "t1", 0), ("c", "s", "t2", 1), ("c", "s", "t2", 2), ("c", "s", "", 3), ("c", "s", None, 4)], kind)
    marked = L.new_memories(old, new)
    assert {r.pos: r.accepted for r in marked.collect()} == {0: False, 1: True, 2: False, 3: True, 4: True}
    assert L.acknowledged(marked).first().asDict() == {"accepted": 3, "deduped": 2}


def test_lookups(spark, memories, events):
    ids = spark.createDataFrame([(2,), (3,), (2,)], "id long")
    assert [r.id for r in L.by_ids(memories, ids).orderBy("id").collect()] == [2, 3]
    assert sorted((r.id, r.conversation_id) for r in L.strict_lookup(ids, memories).collect()) == [(2, "c"), (2, "c"), (3, "c")]
    with pytest.raises(Exception, match="no memory has the id 99"):
        L.strict_lookup(spark.createDataFrame([(99,)], "id long"), memories).collect()
    at = F.lit("2024-01-05").cast("timestamp")
    assert L.is_pending(memories, events, 1, at, 2) and not L.is_pending(memories, events, 1, at, 1)


def test_twins(spark):
    fetched = spark.createDataFrame([("h1", 1), ("h2", 2)], "content_hash string, id long")
    local = spark.createDataFrame([("h1", "first", 0), ("h1", "last", 1), ("h3", "x", 2)], "content_hash string, turn_id string, pos int")
    assert [(r.id, r.turn_id) for r in L.with_twins(fetched, local).collect()] == [(1, "last")]
    assert [r.id for r in L.without_twins(fetched, local).collect()] == [2]


def test_sql_functions_equal_the_states(spark, memories, events):
    """And Catalyst puts their bodies in place of the calls: hash joins, no nested loop."""
    from lorekeep.plans.sql import register

    register(spark, memories, events)
    rows = lambda text: sorted(map(tuple, spark.sql(text).collect()), key=str)
    at = F.lit("2024-01-05").cast("timestamp")
    same = lambda text, df: rows(text) == sorted(map(tuple, df.collect()), key=str)
    assert same("SELECT * FROM enrichment_progress(NULL, 1)", L.progress(memories, events, 1))
    assert same("SELECT * FROM enrichment_progress('c', 1)", L.progress(memories, events, 1).where("conversation_id = 'c'"))
    assert same("SELECT * FROM dead_letter(1, 5)", L.dead_letter(memories, events, 1)) and rows("SELECT * FROM dead_letter(1, 5)")
    for version in (1, 2):
        assert same(f"SELECT * FROM pending_enrichment({version}, TIMESTAMP '2024-01-05', 5, 60D)", L.pending(memories, events, version, at))
    latest = L.latest_enrichment(events).select("memory_id", "id", "enrichment_version", "attempt")
    assert same("SELECT * FROM latest_enrichment(NULL)", latest) and same("SELECT * FROM latest_enrichment('d')", latest.where("memory_id >= 6"))
    both = "SELECT p.conversation_id, count(d.id) FROM enrichment_progress(NULL, 1) p LEFT JOIN dead_letter(1, 5) d ON d.conversation_id = p.conversation_id GROUP BY ALL"
    assert rows(both) == [("c", 2), ("d", 0)]
    for text in ("SELECT * FROM enrichment_progress('c', 1)", "SELECT * FROM dead_letter(1, 5)", both):
        plan = spark.sql(text)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "Join" in plan
    register(spark, memories.limit(0), events.limit(0), "none_")
    assert rows("SELECT * FROM none_enrichment_progress(NULL, 1)") == [] and len(rows("SELECT * FROM enrichment_progress(NULL, 1)")) == 2
