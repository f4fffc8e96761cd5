"""Ranking, fusion, time, diversity and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.config import Search
from lorekeep.operators import bm25 as B
from lorekeep.operators import index as I
from lorekeep.operators import metrics
from lorekeep.operators.dense import dense
from lorekeep.operators.mmr import mmr
from lorekeep.operators.ranking import max_normalized, rrf, top_n
from lorekeep.operators.temporal import temporal_adjust
from lorekeep.plans import retrieval as plan

from .views import index, questions, table, vector_queries, vectors, words_sql

N = 10


def _out(rows, digits=6):
    return rows.select("query_id", "id", F.round("score", digits).alias("score"), F.col("rank").cast("long").alias("rank"))


def bm25_idf(spark, d):
    docs = index(spark, d)
    rows = docs.document_frequency().join(docs.stats(), "conversation_id")
    return rows.select("term", "df", F.round(B.idf(F.col("n_docs"), F.col("df")), 6).alias("idf"))


def bm25_topn(spark, d):
    return _out(I.search(index(spark, d), questions(spark, d), N))


def bm25_topn_stemmed(spark, d):
    return _out(I.search(index(spark, d, stemmed=True), questions(spark, d, stemmed=True), N))


def bm25_topn_scoped(spark, d):
    """Each question in one source: statistics and documents are the source's own."""
    asked = questions(spark, d).withColumn("conversation_id", F.concat(F.lit("src"), F.col("query_id") % 20))
    return _out(I.search(index(spark, d, scoped=True), asked, N))


def dense_topn(spark, d):
    return _out(dense(vectors(spark, d), vector_queries(spark, d), N))


def dense_topn_scoped(spark, d):
    rows = vectors(spark, d).withColumn("conversation_id", F.col("session_id").cast("string"))
    asked = vector_queries(spark, d).withColumn("conversation_id", F.col("session_id").cast("string"))
    return _out(dense(rows, asked, N))


def _two_lists(spark, d):
    rows, asked = vectors(spark, d), vector_queries(spark, d)
    back = asked.withColumn("embedding", F.reverse("embedding"))
    return dense(rows, asked, 20), dense(rows, back, 20)


def rrf_fuse(spark, d):
    return _out(top_n(rrf(list(_two_lists(spark, d)), 60)), 9)


def rrf_k10(spark, d):
    return _out(top_n(rrf(list(_two_lists(spark, d)), 10), N), 9)


def _with_vectors(spark, d):
    """Documents with the vector of their id, if there is one; benchmark items as well. Lexemes are in the index."""
    vecs = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("all").alias("conversation_id"), F.col("source").alias("session_id"))
    docs = docs.join(vecs, "id", "left").withColumn("ts", F.lit(None).cast("timestamp"))
    asked = questions(spark, d).join(vecs.withColumnRenamed("id", "query_id"), "query_id", "left")
    return docs, asked.withColumn("question", F.col("text")).withColumn("question_date", F.lit(None).cast("timestamp"))


def hybrid_candidates(spark, d):
    docs, asked = _with_vectors(spark, d)
    return _out(plan.candidates(docs, asked, Search(rrf_k=60, candidates=100).resolved(), index(spark, d)), 9)


def _search(mode):
    def query(spark, d):
        docs, asked = _with_vectors(spark, d)
        found = plan.search(docs, asked, Search(mode=mode, top_k=N, max_per_session=4), index(spark, d) if mode != "dense" else None)
        return found.select("query_id", F.col("position").cast("long").alias("position"), "id", F.round("score", 6).alias("score"))

    return query


def _timed(spark, d):
    """Events as candidates of the user whose they are, asked about the middle of the time."""
    rows = table(spark, d, "events")
    return rows.select(
        F.col("user_id").alias("query_id"), F.col("event_id").alias("id"), F.round("value", 6).alias("score"), F.col("ts").cast("timestamp").alias("ts"), F.lit("2024-01-15 00:00:00").cast("timestamp").alias("query_time")
    )


def temporal_boost(spark, d):
    return _out(temporal_adjust(_timed(spark, d)))


def temporal_hard_filter(spark, d):
    return _out(temporal_adjust(_timed(spark, d), window_seconds=3600.0, hard=True))


def _candidates(spark, d):
    found = max_normalized(dense(vectors(spark, d), vector_queries(spark, d), 20))
    return found.join(vectors(spark, d).select("id", "embedding", "session_id"), "id")


def mmr_select(spark, d):
    return mmr(_candidates(spark, d), 5, 0.7).select("query_id", F.col("position").cast("long").alias("position"), "id", F.round("score", 6).alias("score"))


def mmr_session_cap(spark, d):
    return mmr(_candidates(spark, d), 5, 0.7, cap=1).select("query_id", F.col("position").cast("long").alias("position"), "id", F.round("score", 6).alias("score"))


def _judged(spark, d):
    """Retrieved are the nearest of each query, gold those of its label, none for every fifth query. A label's ids are counted,
    not gathered, as one label may have a large share of all rows."""
    rows = vectors(spark, d).select("id", "session_id")
    asked = vector_queries(spark, d).select("query_id", "session_id")
    counts = rows.groupBy("session_id").agg(F.count("*").alias("n"))
    met = dense(vectors(spark, d), vector_queries(spark, d), N).select("query_id", "id", "rank").join(rows, "id")
    found = met.join(asked, ["query_id", "session_id"]).groupBy("query_id").agg(F.sort_array(F.collect_list("rank")).alias("found"))
    scored = F.col("query_id") % 250 != 0
    return asked.join(counts, "session_id").join(found, "query_id", "left").select(
        "query_id",
        F.concat(F.lit("label_"), "session_id").alias("grp"),
        F.when(scored & F.col("found").isNotNull(), F.col("found")).otherwise(F.array().cast("array<int>")).alias("hits"),
        F.when(scored, F.col("n")).otherwise(0).alias("wanted"),
    )


def query_metrics(spark, d):
    found, most = F.col("hits"), F.col("wanted")
    measures = {"recall_5": metrics.recall_at(found, most, 5), "ndcg_5": metrics.ndcg_at(found, most, 5), "ndcg_10": metrics.ndcg_at(found, most, 10), "mrr": metrics.reciprocal_rank_at(found)}
    return _judged(spark, d).select("query_id", *(F.round(m, 6).alias(n) for n, m in measures.items()))


def evaluate_report(spark, d):
    rows = metrics.report(_judged(spark, d))
    return rows.select("grp", "n", "skipped", *(F.round(c, 6).alias(c) for c in ("recall_5", "recall_10", "ndcg_5", "ndcg_10", "mrr")))


def skip_budget(spark, d):
    rows = metrics.report(_judged(spark, d)).where("overall = 1")
    return rows.select("n", "skipped", metrics.within_skip_budget(F.col("skipped"), F.col("n") + F.col("skipped")).alias("within"))


QUERIES = {
    f.__name__: f
    for f in (
        bm25_topn, bm25_idf, bm25_topn_stemmed, bm25_topn_scoped, dense_topn, dense_topn_scoped, rrf_fuse, rrf_k10, hybrid_candidates, temporal_boost,
        temporal_hard_filter, mmr_select, mmr_session_cap, query_metrics, evaluate_report, skip_budget,
    )
} | {f"search_{mode}": _search(mode) for mode in ("bm25", "dense", "hybrid")}


def _bm25_sql(conv: str, asked: str) -> str:
    return f"""
docs AS (SELECT doc_id AS id, {conv} AS conv, {words_sql("coalesce(text, chr(32))")} AS lex FROM documents),
post AS (SELECT conv, id, term, count(*) AS tf FROM (SELECT conv, id, unnest(lex) AS term FROM docs) GROUP BY ALL),
st AS (SELECT conv, count(*) AS n, avg(len(lex)) AS avgl FROM docs GROUP BY conv),
df AS (SELECT conv, term, count(*) AS df FROM post GROUP BY ALL),
asked AS ({asked}),
q AS (SELECT qid, conv, term, count(*) AS times FROM (SELECT qid, conv, unnest(lex) AS term FROM asked) GROUP BY ALL),
scored AS (SELECT qid, p.id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(lex) / avgl))), 9) AS score
  FROM q JOIN post p USING (conv, term) JOIN df USING (conv, term) JOIN st USING (conv) JOIN docs d ON d.id = p.id GROUP BY ALL)"""


_ASKED = f"SELECT item_id AS qid, 'all' AS conv, {words_sql('text')} AS lex FROM benchmark"
_SCOPED = f"SELECT item_id AS qid, 'src' || item_id % 20 AS conv, {words_sql('text')} AS lex FROM benchmark"
_TOP = "SELECT qid AS query_id, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM {rows}) WHERE rank <= {n}"
_VEC = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings), q AS (SELECT id AS qid, e, label FROM v WHERE id % 50 = 0)"


def _dense_sql(name: str, query: str = "q.e", where: str = "true") -> str:
    return f"{name} AS (SELECT qid, v.id, round(list_dot_product({query}, v.e), 9) AS score, v.label FROM q, v WHERE {where})"


def _ranked_sql(name: str, rows: str, n: int) -> str:
    return f"{name} AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM {rows} QUALIFY rank <= {n})"


def _rrf_sql(k: int, n: int) -> str:
    lists = f"{_VEC}, {_dense_sql('s1')}, {_dense_sql('s2', 'list_reverse(q.e)')}, {_ranked_sql('l1', 's1', 20)}, {_ranked_sql('l2', 's2', 20)}"
    fused = f"f AS (SELECT qid, id, round(sum(1.0::DOUBLE / ({k} + rank)), 12) AS score FROM (SELECT qid, id, rank FROM l1 UNION ALL SELECT qid, id, rank FROM l2) GROUP BY ALL)"
    return f"WITH {lists}, {fused} {_TOP.format(rows='f', n=n).replace('round(score, 6)', 'round(score, 9)')}"


def _mmr_sql(cap: int) -> str:
    return f"""WITH RECURSIVE {_VEC}, {_dense_sql("s")}, {_ranked_sql("c0", "s", 20)},
c AS (SELECT qid, id, score, label, CASE WHEN max(score) OVER (PARTITION BY qid) > 0 THEN score / max(score) OVER (PARTITION BY qid) ELSE score END AS rel FROM c0),
sim AS (SELECT a.qid, a.id AS i, b.id AS j, list_dot_product(va.e, vb.e) AS s FROM c a JOIN c b ON a.qid = b.qid JOIN v va ON va.id = a.id JOIN v vb ON vb.id = b.id),
r AS (
  SELECT DISTINCT qid, 0 AS step, []::BIGINT[] AS sel, []::BIGINT[] AS sess FROM c
  UNION ALL
  SELECT qid, step + 1, list_append(sel, id), list_append(sess, label) FROM (
    SELECT r.qid, r.step, r.sel, r.sess, c.id, CAST(c.label AS BIGINT) AS label, row_number() OVER (PARTITION BY r.qid ORDER BY
      0.7 * c.rel - 0.3 * coalesce((SELECT max(s) FROM sim WHERE sim.qid = r.qid AND sim.i = c.id AND list_contains(r.sel, sim.j)), 0) DESC, c.rel DESC, c.id) AS n
    FROM r JOIN c ON c.qid = r.qid
    WHERE r.step < 5 AND NOT list_contains(r.sel, c.id) AND len(list_filter(r.sess, lambda x: x = c.label)) < {cap}
  ) WHERE n = 1
)
SELECT r.qid AS query_id, CAST(r.step AS BIGINT) AS position, c.id, round(c.score, 6) AS score FROM r JOIN c ON c.qid = r.qid AND c.id = r.sel[r.step] WHERE r.step > 0"""


_RESULTS = f"""{_VEC}, {_dense_sql("s")}, {_ranked_sql("l", "s", 10)},
res AS (SELECT q.qid, 'label_' || q.label AS grp, (SELECT count(*) FROM v WHERE v.label = q.label) AS wanted, q.qid % 250 <> 0 AS scored FROM q),
hit AS (SELECT l.qid, rank FROM l JOIN q ON q.qid = l.qid WHERE l.label = q.label),
m AS (SELECT res.qid, grp, scored,
  CASE WHEN scored THEN coalesce((SELECT count(*) FROM hit WHERE hit.qid = res.qid AND rank <= 5), 0) / wanted::DOUBLE ELSE 0 END AS recall_5,
  CASE WHEN scored THEN coalesce((SELECT count(*) FROM hit WHERE hit.qid = res.qid AND rank <= 10), 0) / wanted::DOUBLE ELSE 0 END AS recall_10,
  CASE WHEN scored THEN coalesce((SELECT sum(1 / log2(rank + 1)) FROM hit WHERE hit.qid = res.qid AND rank <= 5), 0) / list_sum([1 / log2(i + 1) FOR i IN range(1, 1 + least(5, wanted))]) ELSE 0 END AS ndcg_5,
  CASE WHEN scored THEN coalesce((SELECT sum(1 / log2(rank + 1)) FROM hit WHERE hit.qid = res.qid AND rank <= 10), 0) / list_sum([1 / log2(i + 1) FOR i IN range(1, 1 + least(10, wanted))]) ELSE 0 END AS ndcg_10,
  CASE WHEN scored THEN coalesce((SELECT 1.0::DOUBLE / min(rank) FROM hit WHERE hit.qid = res.qid), 0) ELSE 0 END AS mrr FROM res)"""
_MEANS = ", ".join(f"round(coalesce(avg({c}) FILTER (WHERE scored), 0), 6) AS {c}" for c in ("recall_5", "recall_10", "ndcg_5", "ndcg_10", "mrr"))
_LISTS = f"""{_bm25_sql("'all'", _ASKED)}, {_ranked_sql("l1", "scored", 100)},
s2 AS (SELECT item_id AS qid, doc_id AS id, coalesce(round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9), 0) AS score
  FROM benchmark JOIN embeddings a ON a.vec_id = item_id, documents LEFT JOIN embeddings b ON b.vec_id = doc_id), {_ranked_sql("l2", "s2", 100)},
l12 AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM (SELECT qid, id, rank FROM l1 UNION ALL SELECT qid, id, rank FROM l2) GROUP BY ALL)"""


def _search_sql(rows: str) -> str:
    """The candidates in `rows`, then the greedy choice, at most four of a source; documents without a vector are like none."""
    return f"""WITH RECURSIVE {_LISTS},
c AS MATERIALIZED (SELECT qid, x.id, score, source, CASE WHEN max(score) OVER (PARTITION BY qid) > 0 THEN score / max(score) OVER (PARTITION BY qid) ELSE score END AS rel FROM {rows} x JOIN documents d ON d.doc_id = x.id),
v AS (SELECT DISTINCT c.id, e.embedding::DOUBLE[] AS e FROM c JOIN embeddings e ON e.vec_id = c.id),
sim AS MATERIALIZED (SELECT a.id AS i, b.id AS j, list_dot_product(a.e, b.e) AS s FROM v a, v b),
r AS (
  SELECT DISTINCT qid, 0 AS step, []::BIGINT[] AS sel, []::VARCHAR[] AS sess FROM c
  UNION ALL
  SELECT qid, step + 1, list_append(sel, id), list_append(sess, source) FROM (
    SELECT r.qid, r.step, r.sel, r.sess, c.id, c.source, row_number() OVER (PARTITION BY r.qid ORDER BY 0.7::DOUBLE * c.rel - (1 - 0.7::DOUBLE) *
      CASE WHEN r.step = 0 THEN 0 WHEN r.step > 0 THEN coalesce((SELECT max(coalesce(s, 0)) FROM (SELECT unnest(r.sel) AS j) t LEFT JOIN sim ON sim.i = c.id AND sim.j = t.j), 0) END DESC, c.rel DESC, c.id) AS n
    FROM r JOIN c ON c.qid = r.qid
    WHERE r.step < {N} AND NOT list_contains(r.sel, c.id) AND len(list_filter(r.sess, lambda x: x = c.source)) < 4
  ) WHERE n = 1
)
SELECT r.qid AS query_id, CAST(r.step AS BIGINT) AS position, c.id, round(c.score, 6) AS score FROM r JOIN c ON c.qid = r.qid AND c.id = r.sel[r.step] WHERE r.step > 0"""


_NEAR = "abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 00:00:00')) <= "
SQL = {
    "search_bm25": _search_sql("l1"),
    "search_dense": _search_sql("l2"),
    "search_hybrid": _search_sql("l12"),
    "bm25_idf": f"WITH {_bm25_sql(chr(39) + 'all' + chr(39), _ASKED)} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df JOIN st USING (conv)",
    "bm25_topn": f"WITH {_bm25_sql(chr(39) + 'all' + chr(39), _ASKED)} {_TOP.format(rows='scored', n=10)}",
    "bm25_topn_scoped": f"WITH {_bm25_sql('source', _SCOPED)} {_TOP.format(rows='scored', n=10)}",
    "dense_topn": f"WITH {_VEC}, {_dense_sql('s')} {_TOP.format(rows='s', n=10)}",
    "dense_topn_scoped": f"WITH {_VEC}, {_dense_sql('s', where='v.label = q.label')} {_TOP.format(rows='s', n=10)}",
    "rrf_fuse": _rrf_sql(60, 1000),
    "rrf_k10": _rrf_sql(10, 10),
    "hybrid_candidates": f"""WITH {_bm25_sql("'all'", _ASKED)}, {_ranked_sql("l1", "scored", 100)},
s2 AS (SELECT item_id AS qid, doc_id AS id, coalesce(round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9), 0) AS score
  FROM benchmark JOIN embeddings a ON a.vec_id = item_id, documents LEFT JOIN embeddings b ON b.vec_id = doc_id), {_ranked_sql("l2", "s2", 100)},
f AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM (SELECT qid, id, rank FROM l1 UNION ALL SELECT qid, id, rank FROM l2) GROUP BY ALL)
SELECT qid AS query_id, id, round(score, 9) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM f""",
    "temporal_boost": f"""WITH s AS (SELECT user_id AS qid, event_id AS id, round(value, 6) * CASE WHEN {_NEAR} 1209600000000 THEN 1.3 ELSE 1 END AS score FROM events)
SELECT qid AS query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s""",
    "temporal_hard_filter": f"""WITH s AS (SELECT user_id AS qid, event_id AS id, round(value, 6) AS score, {_NEAR} 3600000000 AS near FROM events),
k AS (SELECT * FROM (SELECT *, max(near::INT) OVER (PARTITION BY qid) AS any_near FROM s) WHERE near OR any_near = 0)
SELECT qid AS query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM k""",
    "mmr_select": _mmr_sql(1000),
    "mmr_session_cap": _mmr_sql(1),
    "query_metrics": f"WITH {_RESULTS} SELECT qid AS query_id, round(recall_5, 6) AS recall_5, round(ndcg_5, 6) AS ndcg_5, round(ndcg_10, 6) AS ndcg_10, round(mrr, 6) AS mrr FROM m",
    "evaluate_report": f"""WITH {_RESULTS} SELECT grp, count(*) FILTER (WHERE scored) AS n, count(*) FILTER (WHERE NOT scored) AS skipped, {_MEANS}
FROM m GROUP BY GROUPING SETS ((), (grp)) HAVING grouping(grp) = 1 OR count(*) FILTER (WHERE scored) > 0""",
    "skip_budget": f"WITH {_RESULTS} SELECT count(*) FILTER (WHERE scored) AS n, count(*) FILTER (WHERE NOT scored) AS skipped, count(*) FILTER (WHERE NOT scored) <= 0.01 * count(*) AS within FROM m",
}
