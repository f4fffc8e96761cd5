"""Search over all conversations and questions at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.config import Mode, Search
from lorekeep.functions.dates import query_time
from lorekeep.operators.dense import dense
from lorekeep.operators.index import Index, temporary_index
from lorekeep.operators.index import search as search_index
from lorekeep.operators.metrics import evaluate
from lorekeep.operators.mmr import mmr
from lorekeep.operators.ranking import max_normalized, rrf, top_n
from lorekeep.operators.rounds import expanded
from lorekeep.operators.temporal import temporal_adjust


def validated(corpus: DataFrame, dims: int) -> DataFrame:
    """The corpus, which fails when it's read if an id is empty or comes twice in a conversation, or a vector has another
    length. The count of each id is one aggregate over ids alone, joined back."""
    counts = corpus.groupBy("conversation_id", "id").agg(F.count("*").alias("_times"))
    rows = corpus.join(counts, ["conversation_id", "id"])
    wrong = (
        F.when(F.coalesce(F.col("id").cast("string"), F.lit("")) == "", "an id is empty")
        .when(F.col("_times") > 1, F.concat(F.lit("an id comes twice: "), F.col("id").cast("string")))
        .when(F.size("embedding") != dims, F.concat(F.lit("a vector has another length: "), F.col("id").cast("string")))
    )
    return rows.withColumn("id", F.when(wrong.isNull(), F.col("id")).otherwise(F.raise_error(wrong).cast(dict(corpus.dtypes)["id"]))).drop("_times")


def candidates(corpus: DataFrame, queries: DataFrame, search: Search, index: Index | None = None) -> DataFrame:
    """query_id, id, score, rank: one list, or the fusion of both, each cut before it's fused. Without a stored index of the
    corpus one is made of its lexemes."""
    lists = []
    if search.mode in (Mode.BM25, Mode.HYBRID):
        lists.append(search_index(index or temporary_index(corpus), queries, search.candidates, search.k1, search.b))
    if search.mode in (Mode.DENSE, Mode.HYBRID):
        lists.append(dense(corpus, queries, search.candidates))
    return lists[0] if len(lists) == 1 else top_n(rrf(lists, search.rrf_k))


def search(corpus: DataFrame, queries: DataFrame, how: Search = Search(), index: Index | None = None) -> DataFrame:
    """corpus(conversation_id, id, session_id, ts, embedding, and lexemes unless a stored index has them),
    queries(query_id, conversation_id, lexemes, embedding, question, question_date as a timestamp) to query_id, position,
    id, score, in the order of selection. The score is the fused and boosted one. Vectors travel to dense search and to the
    last step alone."""
    how = how.resolved()
    found = candidates(corpus, queries, how, index)
    times = queries.select("query_id", "conversation_id", query_time(F.col("question"), F.col("question_date")).alias("query_time"))
    facts = corpus.select("conversation_id", "id", "session_id", "ts", "embedding")
    rows = found.join(times, "query_id").join(facts, ["conversation_id", "id"])
    rows = temporal_adjust(rows, how.window_days * 86400, how.boost, how.hard_filter)
    picked = mmr(max_normalized(rows), how.top_k, how.trade_off, how.max_per_session)
    return picked.select("query_id", "position", "id", "score")


def retrieved(selected: DataFrame) -> DataFrame:
    """query_id and its ids in order; where selected has members, rounds are replaced by their turns."""
    whole = "members" in selected.columns
    item = F.struct("position", "id", "members") if whole else F.struct("position", "id")
    lists = selected.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("_items"))
    ids = F.transform("_items", lambda x: x["id"])
    if whole:
        ids = expanded(ids, F.transform("_items", lambda x: x["members"]))
    return lists.select("query_id", ids.alias("retrieved"))


def report_of(selected: DataFrame, gold: DataFrame, cutoffs: tuple[int, ...] = (5, 10)) -> DataFrame:
    """gold(query_id, grp, gold) and what was selected to the report of metrics.evaluate, all first and then by group."""
    rows = gold.join(retrieved(selected), "query_id", "left")
    return evaluate(rows.withColumn("retrieved", F.coalesce("retrieved", F.array().cast("array<string>"))), cutoffs).orderBy(F.desc("overall"), "grp")
