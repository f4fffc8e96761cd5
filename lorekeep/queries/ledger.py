"""The ledger's states, on orders as memories and line items as attempts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorekeep.operators import ledger as L
from lorekeep.plans.sql import register

from .views import EVENTS_SQL, by_order, events, least_flag_is_a, memories

AS_OF, WAIT = "1995-06-17 00:00:00", 30 * 86400.0


def _pending(spark, d):
    m, e = memories(spark, d), events(spark, d)
    return L.pending(m, e, 1, F.lit(AS_OF).cast("timestamp"), 5, WAIT)


def ledger_pending(spark, d):
    return _pending(spark, d)


def ledger_pending_count(spark, d):
    return _pending(spark, d).agg(F.count("*").alias("n"))


def ledger_progress(spark, d):
    return L.progress(memories(spark, d), events(spark, d), 1)


def ledger_progress_global(spark, d):
    return L.progress(memories(spark, d), events(spark, d), 1, ())


def ledger_dead_letter(spark, d):
    return L.dead_letter(memories(spark, d), events(spark, d), 1, 2)


def ledger_flags(spark, d):
    rows = L.flags(events(spark, d), 2)
    return rows.withColumn("last_fail", F.date_format("last_fail", "yyyy-MM-dd"))


def _asked(spark, d, query):
    """A query of SQL over the table functions."""
    register(spark, memories(spark, d), events(spark, d))
    return spark.sql(query)


def sql_progress(spark, d):
    return _asked(spark, d, "SELECT * FROM enrichment_progress(NULL, 1)")


def sql_dead_letter(spark, d):
    return _asked(spark, d, "SELECT * FROM dead_letter(1, 2)")


def sql_pending(spark, d):
    return _asked(spark, d, f"SELECT * FROM pending_enrichment(1, TIMESTAMP '{AS_OF}', 5, {WAIT}D)")


def sql_latest(spark, d):
    return _asked(spark, d, "SELECT id, memory_id, enrichment_version, attempt FROM latest_enrichment(NULL)")


def _event(rows):
    return rows.select("id", "memory_id", "enrichment_version", "attempt")


def ledger_latest(spark, d):
    return _event(L.latest_enrichment(events(spark, d)))


def ledger_at_version(spark, d):
    return _event(L.enrichment_at_version(events(spark, d), 2))


def ledger_fetch(spark, d):
    return L.fetch_at_version(memories(spark, d), events(spark, d), 1).select("id", "conversation_id", "attempt", F.date_format("created_at", "yyyy-MM-dd").alias("created"))


def append_done(spark, d):
    """What of another run's events may be appended to the ledger: counted by outcome."""
    old = events(spark, d)
    new = old.withColumn("enrichment_version", F.when(F.col("attempt") % 2 == 0, 3).otherwise(F.col("enrichment_version")))
    return L.appendable(old, new).groupBy("enrichment_version", "status").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def plan_ranges(spark, d):
    """The pages of one sweep over all that is pending; it handles as much as a sweep may."""
    return L.plan_pages(_pending(spark, d), 128, 8).select("id", "page")


def plan_ntile(spark, d):
    """Ranges of ids for 8 workers in each conversation."""
    tile = F.ntile(8).over(Window.partitionBy("conversation_id").orderBy("id"))
    return memories(spark, d).select("conversation_id", "id", tile.alias("tile")).groupBy("conversation_id", "tile").agg(F.min("id").alias("first"), F.max("id").alias("last"))


def outcomes(spark, d):
    rows = by_order(spark, d).agg(least_flag_is_a().alias("done"), F.max("l_discount").alias("discount"))
    outcome = F.when(F.col("done"), "done").when(F.col("discount") >= 0.05, "permanent").otherwise("failed")
    return rows.select(F.col("l_orderkey").alias("batch"), (F.col("l_linenumber") - 1).cast("int").alias("idx"), outcome.alias("outcome"))


def batch_outcomes(spark, d):
    return L.batch_outcomes(outcomes(spark, d))


def contiguous_watermark(spark, d):
    return L.contiguous_watermark(outcomes(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        ledger_pending, ledger_pending_count, ledger_progress, ledger_progress_global, ledger_dead_letter, ledger_flags, ledger_latest, ledger_at_version,
        ledger_fetch, append_done, plan_ranges, plan_ntile, batch_outcomes, contiguous_watermark,
        sql_progress, sql_dead_letter, sql_pending, sql_latest,
    )
}


def _states(version: int) -> str:
    return f"""{EVENTS_SQL},
f AS (SELECT memory_id, bool_or(status = 'done') AS has_done, bool_or(status = 'failed' AND permanent) AS has_permanent, count(*) FILTER (WHERE status = 'failed') AS n_fail,
  (array_agg(created_at ORDER BY attempt DESC, id DESC) FILTER (WHERE status = 'failed'))[1] AS last_fail FROM events WHERE enrichment_version = {version} GROUP BY memory_id),
s AS (SELECT m.*, coalesce(has_done, false) AS has_done, coalesce(has_permanent, false) AS has_permanent, coalesce(n_fail, 0) AS n_fail, last_fail FROM memories m LEFT JOIN f ON f.memory_id = m.id)"""


_PENDING = f"""{_states(1)}, p AS (SELECT id, conversation_id FROM s WHERE NOT has_done AND NOT has_permanent AND n_fail < 5
  AND (last_fail IS NULL OR epoch(TIMESTAMP '{AS_OF}') - epoch(last_fail) > {WAIT} * power(2, least(n_fail, 6))))"""
_COUNTS = "count(*) AS total, count(*) FILTER (WHERE has_done) AS done, count(*) FILTER (WHERE NOT has_done) AS remaining, count(*) FILTER (WHERE has_permanent) AS dead"
_DONE = f"WITH {EVENTS_SQL} SELECT id, memory_id, enrichment_version, attempt FROM events WHERE status = 'done'"
_OUT = """o AS (SELECT l_orderkey AS batch, CAST(l_linenumber - 1 AS INT) AS idx,
  CASE WHEN min(l_returnflag) = 'A' THEN 'done' WHEN max(l_discount) >= 0.05 THEN 'permanent' ELSE 'failed' END AS outcome FROM lineitem GROUP BY l_orderkey, l_linenumber)"""
SQL = {
    "ledger_pending": f"WITH {_PENDING} SELECT * FROM p",
    "ledger_pending_count": f"WITH {_PENDING} SELECT count(*) AS n FROM p",
    "ledger_progress": f"WITH {_states(1)} SELECT conversation_id, {_COUNTS} FROM s GROUP BY conversation_id",
    "ledger_progress_global": f"WITH {_states(1)} SELECT {_COUNTS} FROM s",
    "ledger_dead_letter": f"WITH {_states(1)} SELECT id, conversation_id FROM s WHERE NOT has_done AND (has_permanent OR n_fail >= 2)",
    "ledger_flags": f"WITH {_states(2)} SELECT memory_id, has_done, has_permanent, n_fail, strftime(last_fail, '%Y-%m-%d') AS last_fail FROM f",
    "ledger_latest": f"{_DONE} QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY enrichment_version DESC, id DESC) = 1",
    "ledger_at_version": f"{_DONE} AND enrichment_version = 2",
    "ledger_fetch": f"WITH {EVENTS_SQL} SELECT m.id, conversation_id, attempt, strftime(created_at, '%Y-%m-%d') AS created FROM memories m JOIN events e ON e.memory_id = m.id WHERE status = 'done' AND enrichment_version = 1",
    "append_done": f"""WITH {EVENTS_SQL},
new AS (SELECT id, memory_id, CASE WHEN attempt % 2 = 0 THEN 3 ELSE enrichment_version END AS enrichment_version, status FROM events),
ok AS (SELECT * FROM new WHERE status = 'failed' UNION ALL
  SELECT * FROM (SELECT * FROM new WHERE status = 'done' QUALIFY row_number() OVER (PARTITION BY memory_id, enrichment_version ORDER BY id) = 1) x
  WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.status = 'done' AND e.memory_id = x.memory_id AND e.enrichment_version = x.enrichment_version))
SELECT enrichment_version, status, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM ok GROUP BY ALL""",
    "plan_ranges": f"WITH {_PENDING} SELECT id, CAST((row_number() OVER (ORDER BY id) - 1) // 128 AS INT) AS page FROM (SELECT id FROM p ORDER BY id LIMIT 1024)",
    "plan_ntile": f"""WITH {EVENTS_SQL}, t AS (SELECT conversation_id, id, CAST(ntile(8) OVER (PARTITION BY conversation_id ORDER BY id) AS INT) AS tile FROM memories)
SELECT conversation_id, tile, min(id) AS first, max(id) AS last FROM t GROUP BY ALL""",
    "batch_outcomes": f"""WITH {_OUT}, c AS (SELECT batch, count(*) FILTER (WHERE outcome = 'done') AS done, count(*) FILTER (WHERE outcome = 'failed') AS failed,
  count(*) FILTER (WHERE outcome = 'permanent') AS permanent FROM o GROUP BY batch) SELECT *, failed > 0 AND done = 0 AS batch_failed FROM c""",
    "contiguous_watermark": f"WITH {_OUT} SELECT batch, coalesce(min(idx) FILTER (WHERE outcome = 'failed'), max(idx) + 1) AS watermark FROM o GROUP BY batch",
}
SQL |= {f"sql_{name}": SQL[f"ledger_{name}"] for name in ("progress", "dead_letter", "pending", "latest")}
