"""Turns, rounds and granularity."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.operators import rounds as R

from .views import TURNS_SQL, turns


def rounds_assemble(spark, d):
    rows = R.rounds(turns(spark, d))
    return rows.select("round_id", F.array_join("turn_ids", "+").alias("turn_ids"), F.md5(F.col("text").cast("binary")).alias("text_md5"), "pos")


def rounds_ingest(spark, d):
    return R.round_items(turns(spark, d)).select("conversation_id", "session_id", "id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "pos")


def _items(spark, d):
    rows = turns(spark, d)
    alone = rows.select("conversation_id", "session_id", F.col("turn_id").alias("id"), "pos").withColumn("members", F.lit(None).cast("array<string>"))
    return alone.unionByName(R.round_items(rows).select(*alone.columns))


def _granularity(name):
    def query(spark, d):
        return R.at_granularity(_items(spark, d), name).select("conversation_id", "id", F.coalesce(F.size("members"), F.lit(1)).alias("n_turns"))

    return query


def union_turn_round(spark, d):
    return _items(spark, d).groupBy("conversation_id").agg(F.count("*").alias("items"), F.count_if(F.col("members").isNotNull()).alias("rounds"))


def expand_retrieved(spark, d):
    """Each session's items, the last first, with rounds replaced by their turns."""
    item = F.struct((-F.col("pos")).alias("at"), F.col("members").isNull().alias("alone"), "id", "members")
    lists = _items(spark, d).groupBy("conversation_id", "session_id").agg(F.array_sort(F.collect_list(item)).alias("x"))
    ids = R.expanded(F.transform("x", lambda i: i["id"]), F.transform("x", lambda i: i["members"]))
    return lists.select("conversation_id", "session_id", F.array_join(ids, ",").alias("turn_ids"))


QUERIES = {f.__name__: f for f in (rounds_assemble, rounds_ingest, union_turn_round, expand_retrieved)} | {
    f"granularity_{name}": _granularity(name) for name in ("turn", "round", "all")
}

_SEATED = f"""{TURNS_SQL},
b AS (SELECT *, CASE WHEN coalesce(lag(pos) OVER w <> pos - 1 OR lag(speaker) OVER w IS NOT DISTINCT FROM speaker, true) THEN 1 ELSE 0 END AS brk
  FROM turns WINDOW w AS (PARTITION BY conversation_id, session_id ORDER BY pos)),
i AS (SELECT *, sum(brk) OVER (PARTITION BY conversation_id, session_id ORDER BY pos) AS island FROM b),
s AS (SELECT *, (row_number() OVER (PARTITION BY conversation_id, session_id, island ORDER BY pos) - 1) % 2 + 1 AS seat FROM i),
n AS (SELECT *, CAST(sum(CASE WHEN seat = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conversation_id, session_id ORDER BY pos) - 1 AS INT) AS round_no FROM s),
r AS (SELECT conversation_id, session_id, round_no, string_agg(turn_id, '+' ORDER BY seat) AS turn_ids, count(*) AS n_turns,
  md5(string_agg(speaker || ': ' || text, chr(10) ORDER BY seat)) AS text_md5, min(pos) AS pos FROM n GROUP BY ALL),
items AS (SELECT conversation_id, session_id, turn_id AS id, pos, 1 AS n_turns, false AS whole, turn_id AS turn_ids FROM turns
  UNION ALL SELECT conversation_id, session_id, turn_ids, pos, 2, true, turn_ids FROM r WHERE n_turns = 2)"""
SQL = {
    "rounds_assemble": f"WITH {_SEATED} SELECT session_id || ':round:' || round_no AS round_id, turn_ids, text_md5, pos FROM r",
    "rounds_ingest": f"WITH {_SEATED} SELECT conversation_id, session_id, turn_ids AS id, text_md5, pos FROM r WHERE n_turns = 2",
    "union_turn_round": f"WITH {_SEATED} SELECT conversation_id, count(*) AS items, count(*) FILTER (WHERE whole) AS rounds FROM items GROUP BY conversation_id",
    "granularity_turn": f"WITH {_SEATED} SELECT conversation_id, id, n_turns FROM items WHERE NOT whole",
    "granularity_all": f"WITH {_SEATED} SELECT conversation_id, id, n_turns FROM items",
    "granularity_round": f"""WITH {_SEATED} SELECT conversation_id, id, n_turns FROM items i WHERE whole OR NOT EXISTS (
  SELECT 1 FROM n JOIN r USING (conversation_id, session_id, round_no) WHERE r.n_turns = 2 AND n.turn_id = i.id)""",
    "expand_retrieved": f"""WITH {_SEATED},
x AS (SELECT conversation_id, session_id, pos, whole, id, unnest(string_split(turn_ids, '+')) AS turn_id, generate_subscripts(string_split(turn_ids, '+'), 1) AS k FROM items),
y AS (SELECT conversation_id, session_id, turn_id, min(row_number) AS place FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY -pos, NOT whole, id, k) AS row_number FROM x) GROUP BY ALL)
SELECT conversation_id, session_id, string_agg(turn_id, ',' ORDER BY place) AS turn_ids FROM y GROUP BY conversation_id, session_id""",
}
