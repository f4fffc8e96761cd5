"""The ledger's states as table functions of SQL, which Catalyst puts in place of their calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorekeep.operators.ledger import MOST_DOUBLINGS

_STATES = """
  SELECT m.*, coalesce(f.has_done, false) AS has_done, coalesce(f.has_permanent, false) AS has_permanent, coalesce(f.n_fail, 0) AS n_fail, f.last_fail
  FROM {memories} m LEFT JOIN (
    SELECT memory_id, bool_or(status = 'done') AS has_done, bool_or(status = 'failed' AND permanent) AS has_permanent, count_if(status = 'failed') AS n_fail,
      max_by(CASE WHEN status = 'failed' THEN created_at END, CASE WHEN status = 'failed' THEN struct(attempt, id) END) AS last_fail
    FROM {events} WHERE enrichment_version = version GROUP BY memory_id
  ) f ON m.id = f.memory_id"""

#: Name, parameters, columns and body of each function. A conversation that is null stands for every one.
FUNCTIONS = {
    "enrichment_progress": (
        "conversation STRING, version INT",
        "conversation_id STRING, total BIGINT, done BIGINT, remaining BIGINT, dead BIGINT",
        "SELECT conversation_id, count(*), count_if(has_done), count_if(NOT has_done), count_if(has_permanent) FROM ({states}) "
        "WHERE conversation IS NULL OR conversation_id = conversation GROUP BY conversation_id",
    ),
    "dead_letter": (
        "version INT, max_attempts INT",
        "id BIGINT, conversation_id STRING",
        "SELECT id, conversation_id FROM ({states}) WHERE NOT has_done AND (has_permanent OR n_fail >= max_attempts)",
    ),
    "pending_enrichment": (
        "version INT, as_of TIMESTAMP, max_attempts INT, base_seconds DOUBLE",
        "id BIGINT, conversation_id STRING",
        "SELECT id, conversation_id FROM ({states}) WHERE NOT has_done AND NOT has_permanent AND n_fail < max_attempts AND (last_fail IS NULL "
        f"OR (unix_micros(as_of) - unix_micros(last_fail)) / 1e6D > pow(2D, least(n_fail, {MOST_DOUBLINGS})) * base_seconds)",
    ),
    "latest_enrichment": (
        "conversation STRING",
        "memory_id BIGINT, id BIGINT, enrichment_version INT, attempt INT",
        "SELECT memory_id, x.id, x.enrichment_version, x.attempt FROM (SELECT e.memory_id, "
        "max_by(struct(e.id, CAST(e.enrichment_version AS INT) AS enrichment_version, e.attempt), struct(e.enrichment_version, e.id)) AS x "
        "FROM {events} e LEFT JOIN {memories} m ON m.id = e.memory_id WHERE e.status = 'done' AND (conversation IS NULL OR m.conversation_id = conversation) GROUP BY e.memory_id)",
    ),
}


def register(spark: SparkSession, memories: DataFrame, events: DataFrame, prefix: str = "") -> None:
    """Makes the functions known to the session, over these memories (id, conversation_id) and events. Another prefix gives
    functions over others beside them."""
    views = {"memories": f"{prefix}ledger_memories", "events": f"{prefix}ledger_events"}
    memories.selectExpr("id", "CAST(conversation_id AS STRING) AS conversation_id").createOrReplaceTempView(views["memories"])
    events.createOrReplaceTempView(views["events"])
    for name, (parameters, columns, body) in FUNCTIONS.items():
        body = body.format(states=_STATES.format(**views), **views)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS TABLE ({columns}) RETURN {body}")
