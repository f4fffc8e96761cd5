from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep import schemas
from lorekeep.config import Enrichment, Search
from lorekeep.operators import embed as E
from lorekeep.operators import ledger as L
from lorekeep.plans import retrieval
from lorekeep.streaming.ingest import BLOBS, LEDGER, append, ingested, stored, texts_of, throughput
from lorekeep.streaming.sweep import Sweeper, wait_enriched


def test_attempt_isolates_and_tries_again():
    good = E.MockEmbedder(4)
    calls = []

    def flaky(texts):
        calls.append(len(texts))
        if len(calls) == 1:
            raise ConnectionError("once")
        return good(texts)

    assert [v is not None for v, _, _ in E.attempt(flaky, ["a", "b"], 4)] == [True, True]
    got = E.attempt(E.MockEmbedder(4, "bad", True), ["fine", "bad one", "fine too"], 4)
    assert [(v is not None, e, p) for v, e, p in got] == [(True, None, False), (False, "refused", True), (True, None, False)]
    assert E.attempt(E.MockEmbedder(3), ["x"], 4)[0][2] is True
    assert E.attempt(E.MockEmbedder(4, "x"), ["x"], 4)[0][1:] == ("out of order", False)
    assert np.isclose(np.linalg.norm(good(["t"])[0]), 1) and (good(["t"])[0] == good(["t"])[0]).all()


def test_embed_uses_the_cache_and_each_text_once(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "search_query: a")], "id long, text string")
    empty = spark.createDataFrame([], schemas.CACHE)
    run = lambda cache: E.embed(texts, cache, "search_document: ", "mock", partial(E.MockEmbedder, 4), 4)
    first = {r.id: r for r in run(empty).collect()}
    assert first[1].embedding == first[3].embedding != first[2].embedding and not first[1].cached
    assert first[4].embedding is None and first[4].permanent and "prefix" in first[4].error_message
    new = E.cacheable(run(empty), empty, "search_document: ", "mock", 4, F.lit("2024-01-01").cast("timestamp"))
    cache = spark.createDataFrame(new.collect(), schemas.CACHE)
    assert cache.count() == 2
    second = {r.id: r for r in run(cache).collect()}
    assert second[1].cached and second[1].embedding == first[1].embedding
    assert E.cache_misses(texts, cache, "search_query: ", "mock").count() == 3


@pytest.fixture
def ledger(spark, tmp_path):
    memories = spark.createDataFrame([(i, "c") for i in range(1, 21)], "id long, conversation_id string")
    texts = spark.createDataFrame([(i, "user", f"text number {i}" + (" bad" if i == 7 else ""), "2023-05-02 10:15") for i in range(1, 21)], "id long, speaker string, text string, date_time string")
    return f"file://{tmp_path}/ledger", memories, texts


def test_a_sweep_drains_and_dead_ones_are_told(spark, ledger):
    folder, memories, texts = ledger
    config = Enrichment(batch_size=8, batches=2, dims=4)
    sweeper = Sweeper(spark, folder, memories, texts, partial(E.MockEmbedder, 4, "bad", True), config)
    at = F.lit("2024-01-01").cast("timestamp")
    waves = sweeper.run(lambda: at, pause=0)
    assert sum(w.get("done", 0) for w in waves) == 19 and sum(w.get("permanent", 0) for w in waves) == 1 and len(waves) == 2
    assert sweeper.run(lambda: at, pause=0) == []
    assert [r.id for r in L.dead_letter(memories, sweeper.events(), 1).collect()] == [7]
    row = L.fetch_at_version(memories, sweeper.events(), 1).where("id = 1").first()
    assert row.lexemes == ["2023", "05", "02", "user", "text", "number", "1"] and str(row.ts) == "2023-05-02 10:15:00" and len(row.embedding) == 16
    with pytest.raises(RuntimeError):
        wait_enriched(sweeper, 5, 0.1)
    assert sweeper.events().select("id").distinct().count() == 20


def test_an_outage_leaves_the_rest_for_later(spark, ledger):
    folder, memories, texts = ledger
    config = Enrichment(batch_size=32, batches=1, dims=4, backoff_seconds=60.0)
    down = Sweeper(spark, folder, memories, texts, partial(E.MockEmbedder, 4, "text"), config)
    early, late = (F.lit(x).cast("timestamp") for x in ("2024-01-01 00:00:00", "2024-01-01 01:00:00"))
    assert down.wave(early) == {"failed": 20} and down.backlog(early).isEmpty()
    up = Sweeper(spark, folder, memories, texts, partial(E.MockEmbedder, 4), config)
    assert up.wave(late) == {"done": 20} and wait_enriched(up, 5, 0.1)


def test_a_text_that_is_lost_is_a_failure(spark, ledger):
    folder, memories, texts = ledger
    sweeper = Sweeper(spark, folder, memories, texts.where("id <> 3"), partial(E.MockEmbedder, 4), Enrichment(batch_size=32, batches=1, dims=4))
    assert sweeper.wave(F.lit("2024-01-01").cast("timestamp")) == {"done": 19, "failed": 1}
    assert sweeper.events().where("status = 'failed'").first().error_message == "its text isn't there"
    assert E.task_type("search_query: ") == "query" and E.task_type("search_document: ") == "document"


def test_stream_ingest_runs_again_without_repeating(spark, tmp_path):
    kind = "conversation_id string, session_id string, turn_id string, speaker string, text string, date_time string, pos int"
    rows = spark.createDataFrame([("c", "s", "t1", "u", "same", "", 0), ("c", "s", "t1", "u", "same", "", 1), ("c", "s", "t2", "u", "other", "", 2)], kind)
    rows.write.parquet(f"{tmp_path}/in/1")
    source = lambda: spark.readStream.schema(kind).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    folder = f"file://{tmp_path}/ledger"
    assert ingested(source(), folder).count() == 2
    rows.withColumn("pos", F.col("pos") + 10).write.parquet(f"{tmp_path}/in/2")
    assert ingested(source(), folder).count() == 2
    assert stored(spark, f"{folder}/blobs", "s3_key string, body string").count() == 2


def test_a_batch_that_runs_again_repeats_nothing(spark, tmp_path):
    """Rows without a turn_id included, which no key tells apart; ids stay, are each row's own and rise with the batches."""
    kind = "conversation_id string, session_id string, turn_id string, speaker string, text string, date_time string, pos int"
    rows = spark.createDataFrame([("c", "s", "", "u", "same", "", 0), ("c", "s", None, "u", "same", "", 1), ("d", "s", "t2", "u", "other", "", 2), ("d", "s", "t2", "u", "changed", "", 3)], kind)
    folder = f"file://{tmp_path}/ledger"
    read = lambda: stored(spark, f"{folder}/memories", LEDGER)
    append(rows, folder, "a", 0)
    first = {r.id: r.s3_key for r in read().collect()}
    assert len(first) == 3
    append(rows, folder, "a", 0)
    assert {r.id: r.s3_key for r in read().collect()} == first
    assert stored(spark, f"{folder}/blobs", BLOBS).count() == 2
    append(rows, folder, "a", 1)
    after = sorted(r.id for r in read().collect())
    assert len(set(after)) == 5 and after[:3] == sorted(first) and stored(spark, f"{folder}/blobs", BLOBS).count() == 2
    texts = {r.id: r.text for r in texts_of(spark, folder, read()).collect()}
    assert sorted(texts.values()) == ["other", "same", "same", "same", "same"]
    lost = read().limit(1).withColumn("s3_key", F.lit("not there"))
    with pytest.raises(Exception, match="not there"):
        texts_of(spark, folder, lost).collect()


UPLOADS = "conversation_id string, session_id string, turn_id string, speaker string, text string, date_time string, pos int"


@pytest.mark.parametrize("part", ["memories", "blobs", "batches"])
def test_a_batch_of_which_a_part_is_lost_is_made_whole(spark, tmp_path, part):
    """As if the writer had died while it committed: whatever files are there, the batch that runs again adds the rest."""
    rows = spark.createDataFrame([(f"c{i % 8}", "s", None if i % 9 == 0 else f"t{i}", "u", f"text {i}", "", i) for i in range(40)], UPLOADS).repartition(4)
    folder = f"file://{tmp_path}/ledger"
    before = [(f"c{i}", "s", "old", "u", f"old {i}", "", 0) for i in range(8)]
    append(spark.createDataFrame(before, UPLOADS), folder, "a", 6)
    assert append(rows, folder, "a", 7) == {"accepted": 40, "deduped": 0}
    read = lambda: {r.id: (r.turn_id, r.pos, r.s3_key) for r in stored(spark, f"{folder}/memories", LEDGER).collect()}
    whole = read()
    assert len(whole) == 48 and sorted(whole) == list(range(1, 49))
    files = sorted(x for x in (tmp_path / "ledger" / part).rglob("*.parquet"))
    for x in files[1::2] if part != "batches" else []:
        x.unlink()
    append(rows, folder, "a", 7)
    append(spark.createDataFrame(before, UPLOADS), folder, "a", 6)
    assert read() == whole
    assert len(texts_of(spark, folder, stored(spark, f"{folder}/memories", LEDGER)).collect()) == 48
    assert append(rows, folder, "a", 8) == {"accepted": 5, "deduped": 35}  # those without a turn_id are new each time
    assert append(rows, folder, "a", 9)["accepted"] == 5 and append(rows, folder, "a", 7)["accepted"] == 0
    assert sorted(read()) == list(range(1, 59))


def test_ids_do_not_run_out_and_small_files_are_joined(spark, tmp_path, monkeypatch):
    from lorekeep.streaming import ingest

    monkeypatch.setattr(ingest, "MOST_FILES", 3)
    folder = f"file://{tmp_path}/ledger"
    spark.createDataFrame([("x", 10**9, 1 << 61, 5)], ingest.BATCHES).write.parquet(f"{folder}/batches")
    for k in range(5):
        append(spark.createDataFrame([("c", "s", f"t{k}", "u", "x", "", k)], UPLOADS), folder, "a", k)
    assert sorted(r.id for r in stored(spark, f"{folder}/memories", LEDGER).collect()) == [(1 << 61) + 5 + k for k in range(5)]
    assert len(list((tmp_path / "ledger" / "batches").glob("part-*"))) <= 4 and len(list((tmp_path / "ledger" / "staged").glob("*/*"))) == 2


def test_a_stream_forgets_what_it_has_seen_and_the_ledger_does_not(spark, tmp_path):
    """Repeats inside the bound never come to the ledger, later ones are deduplicated there; the state stays small."""
    kind = f"{UPLOADS}, sent timestamp"
    schema = spark.createDataFrame([], kind).schema
    time = lambda minutes: F.timestamp_seconds(F.lit(1_600_000_000 + minutes * 60))
    for i in range(4):  # each hour ten new rows, the same again, and those of the first hour
        rows = [("c", "s", f"t{i}_{k}", "u", "x", "", 10 * i + k) for k in range(10)]
        more = [(*r[:6], 1000 + r[6]) for r in rows] + [("c", "s", f"t0_{k}", "u", "x", "", 2000 + k) for k in range(10)] + [("c", "s", None, "u", f"n{i}", "", 0)]
        spark.createDataFrame(rows + more, UPLOADS).withColumn("sent", time(60 * i)).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    folder = f"file://{tmp_path}/ledger"
    query = ingest_query(stream, folder)
    got = stored(spark, f"{folder}/memories", LEDGER)
    assert got.where("turn_id is not null").count() == 40 == got.where("turn_id is not null").select("turn_id").distinct().count() and got.where("turn_id is null").count() == 4
    states = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
    assert max(s["numRowsTotal"] for s in states) <= 30 and sum(s["numRowsRemoved"] for s in states) > 15 and not any(s["numRowsDroppedByWatermark"] for s in states)


def ingest_query(stream, folder):
    from lorekeep.streaming.ingest import ingest

    query = ingest(stream, folder, f"{folder}/checkpoint", "sent", "30 minutes")
    query.awaitTermination()
    return query


def test_texts_are_cut_for_the_service_only(spark):
    long = "é" * 700
    rows = spark.createDataFrame([(1, long), (2, long + "x")], "id long, text string")
    cache = spark.createDataFrame([], "content_hash binary, model string, task_prefix string, dims smallint, vector binary, created_at timestamp")
    got = E.embed(rows, cache, "search_document: ", "m", partial(E.MockEmbedder, 4), 4).orderBy("id").collect()
    assert got[0].embedding == got[1].embedding and got[0].content_hash != got[1].content_hash
    whole = E.embed(rows, cache, "search_document: ", "m", partial(E.MockEmbedder, 4), 4, most_bytes=0).orderBy("id").collect()
    assert whole[0].embedding != whole[1].embedding


def test_throughput(spark):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:00:00", "a")], "t string, event_type string")
    out = throughput(rows.withColumn("ts", F.col("t").cast("timestamp"))).orderBy("start").collect()
    assert [r.n for r in out] == [2, 1]


def test_search(spark):
    docs = [("c", "z_near", "s1", ["pari", "trip"], "2023-05-11", [1.0, 0.0]), ("c", "a_far", "s1", ["pari", "trip"], "2023-01-01", [1.0, 0.0]), ("c", "other", "s2", ["cat"], None, [0.0, 1.0])]
    corpus = spark.createDataFrame(docs, "conversation_id string, id string, session_id string, lexemes array<string>, t string, embedding array<float>").withColumn("ts", F.col("t").cast("timestamp"))

    def ask(question, mode, **more):
        q = spark.createDataFrame([("q", "c", ["pari"], [1.0, 0.0], question, "2023-05-12")], "query_id string, conversation_id string, lexemes array<string>, embedding array<float>, question string, d string")
        out = retrieval.search(corpus, q.withColumn("question_date", F.col("d").cast("timestamp")), Search(mode=mode, **more))
        return [r.id for r in out.orderBy("position").collect()]

    assert ask("paris", "bm25") == ["a_far", "z_near"]
    assert ask("paris yesterday", "bm25") == ["z_near", "a_far"]
    assert ask("paris", "dense")[0] == "a_far" and len(ask("paris", "dense")) == 3
    assert ask("paris", "hybrid", max_per_session=1) == ["a_far", "other"]


def test_validated(spark):
    kind = "conversation_id string, id string, embedding array<float>"
    fine = spark.createDataFrame([("c", "a", [1.0, 2.0]), ("d", "a", None)], kind)
    assert retrieval.validated(fine, 2).count() == 2
    for rows, message in (([("c", "", [1.0, 2.0])], "empty"), ([("c", "a", None), ("c", "a", None)], "twice"), ([("c", "a", [1.0])], "length")):
        with pytest.raises(Exception, match=message):
            retrieval.validated(spark.createDataFrame(rows, kind), 2).collect()
