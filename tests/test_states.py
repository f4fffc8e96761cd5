import random

from pyspark.sql import functions as F

from lorekeep.operators import ledger as L
from lorekeep.streaming import states

START = 1_700_000_000


def as_stream(spark, rows, kind, path, parts):
    """The rows in so many files, one after the other."""
    step = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * step : (i + 1) * step], kind).coalesce(1).write.parquet(f"{path}/{i}")
    return spark.readStream.schema(spark.createDataFrame([], kind).schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(path))


def test_pending_changes_equal_the_batch(spark, tmp_path):
    """At any time, whatever is told until then is what the batch derives of the events until then."""
    rnd = random.Random(3)
    rows = [(m, 0, None, "memory", False, START + 10 * m) for m in range(30)]
    for i in range(1, 260):
        status = rnd.choices(["failed", "done"], [9, 1])[0]
        rows.append((rnd.randrange(34), i, rnd.randint(1, 4), status, status == "failed" and rnd.random() < 0.05, START + 300 + 37 * i + rnd.choice([0, 0, 17])))
    rows.sort(key=lambda r: r[5])
    last = rows[-1][5]
    rows.append((999, 999, 1, "failed", False, last + 10**6))  # the watermark gets past all waits
    kind = "memory_id long, id long, attempt int, status string, permanent boolean, seconds long"
    log = as_stream(spark, rows, kind, tmp_path / "log", 3).withColumn("at", F.timestamp_seconds("seconds")).drop("seconds")
    before = spark.conf.get(states.PROVIDER, None)
    changes = states.run_to_end(spark, states.pending_changes(log, 5, 60.0), f"file://{tmp_path}", "append")
    assert spark.conf.get(states.PROVIDER, None) == before
    told = changes.orderBy("memory_id", "seq").collect()
    for a, b in zip(told, told[1:]):  # each is a change, in order
        assert a.memory_id != b.memory_id or (a.micros <= b.micros and a.pending != b.pending and a.seq + 1 == b.seq)
    events = spark.createDataFrame([(r[1], r[0], 1, r[2], r[3], r[4], r[5]) for r in rows if r[3] != "memory"], "id long, memory_id long, enrichment_version int, attempt int, status string, permanent boolean, s long")
    events = events.withColumn("created_at", F.timestamp_seconds("s"))
    sizes = set()
    for seconds in (START + 150, START + 1200, START + 4000, START + 4000.25, START + 8000, last, last + 5000):
        at = F.timestamp_micros(F.lit(int(seconds * 10**6)))
        known = spark.createDataFrame([(m,) for m in range(30) if START + 10 * m <= seconds], "id long")
        want = {r.id for r in L.pending(known, events.where(F.col("created_at") <= at), 1, at, 5, 60.0).collect()}
        assert {r.memory_id for r in states.pending_at(changes, int(seconds * 10**6)).collect()} == want
        sizes.add(len(want))
    assert len(sizes) > 3


def test_prefixes_equal_the_batch(spark, tmp_path):
    """Items in any order, some over twice, some failed first; holes hold the prefix back."""
    rnd = random.Random(5)
    rows = [(b, i, "failed" if (b * 7 + i) % 5 == 0 else rnd.choice(["done", "permanent"])) for b in range(12) for i in range(8)]
    again = [(b, i, "done") for b, i, o in rows if o == "failed" and b % 2]
    rnd.shuffle(rows)
    rows += rows[:9] + again
    stream = as_stream(spark, rows, "batch long, idx int, outcome string", tmp_path / "in", 2)
    changes = states.run_to_end(spark, states.prefix_changes(stream), f"file://{tmp_path}", "update")
    got = {r.batch: r.watermark for r in states.reached(changes).collect()}
    final = {(b, i): o for b, i, o in rows}
    table = spark.createDataFrame([(b, i, o) for (b, i), o in final.items()], "batch long, idx int, outcome string")
    want = {r.batch: r.watermark for r in L.contiguous_watermark(table).collect()}
    assert got == {b: w for b, w in want.items() if w} and len(got) > 8


def test_pending_states_lie_in_buckets(spark, tmp_path):
    """Of many memories there is a state for each bucket, not for each memory, and a memory without an id is one too."""
    n = 3 * states.BUCKETS
    rows = [(m if m else None, 0, None, "memory", False, START) for m in range(n)] + [(m, m, 1, "failed" if m % 3 else "done", m % 3 == 2, START + 60) for m in range(1, n, 2)]
    rows += [(n + 5, 10**9, 1, "failed", False, START + 10**4), (n + 6, 10**9, 1, "failed", False, START + 10**6)]
    log = as_stream(spark, rows, "memory_id long, id long, attempt int, status string, permanent boolean, seconds long", tmp_path / "log", 2)
    log = log.withColumn("at", F.timestamp_seconds("seconds")).drop("seconds")
    changes = states.run_to_end(spark, states.pending_changes(log, 5, 60.0), f"file://{tmp_path}", "append")
    held = spark.read.format("statestore").load(f"file://{tmp_path}/checkpoint")
    assert held.count() <= states.BUCKETS + 1
    at = lambda seconds: {r.memory_id for r in states.pending_at(changes, (START + seconds) * 10**6).collect()}
    even = {None, *range(2, n, 2)}
    assert at(30) == {None, *range(1, n)} and at(100) == even
    assert at(60 + 121) == even | {m for m in range(1, n, 2) if m % 3 == 1}


def test_prefix_states_lie_in_buckets(spark, tmp_path):
    """Of many batches there is a state for each bucket, not for each batch; those held up by a hole go on from it."""
    n = 2 * states.BUCKETS
    rows = [(b, i, "failed" if i == 1 and b % 4 == 0 else "done") for i in (2, 1, 0) for b in range(n)]
    rows += [(b, 1, None) for b in range(0, n, 8)] + [(None, 0, "done")] + [(b, 3, "failed") for b in range(n)]
    stream = as_stream(spark, rows, "batch long, idx int, outcome string", tmp_path / "in", 2)
    told = states.run_to_end(spark, states.prefix_changes(stream), f"file://{tmp_path}", "update")
    got = {r.batch: r.watermark for r in states.reached(told).collect()}
    assert got == {None: 1} | {b: 1 if b % 4 == 0 and b % 8 else 3 for b in range(n)}
    assert spark.read.format("statestore").load(f"file://{tmp_path}/checkpoint").count() <= states.BUCKETS + 1
