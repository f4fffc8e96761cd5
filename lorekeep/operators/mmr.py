"""Maximal marginal relevance: the one operator that is sequential, over a bounded number of candidates per query."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "query_id {q}, id {i}, position int, score double, relevance double"


def select(relevance: np.ndarray, similarity: np.ndarray, sessions: list, k: int, trade_off: float, cap: int) -> list[int]:
    """Indices in the order of selection. Each step takes the greatest trade_off * relevance - (1 - trade_off) * the
    greatest similarity to what is taken, the first of equals; sessions that have reached the cap are out."""
    n = len(relevance)
    k = n if k <= 0 or k > n else k
    free, nearest, taken, used = np.ones(n, bool), np.zeros(n), [], {}
    for _ in range(k):
        if not free.any():
            break
        gain = np.where(free, trade_off * relevance - (1 - trade_off) * nearest, -np.inf)
        i = int(gain.argmax())
        nearest = similarity[i].copy() if not taken else np.maximum(nearest, similarity[i])
        taken.append(i)
        free[i] = False
        used[sessions[i]] = used.get(sessions[i], 0) + 1
        if cap > 0 and used[sessions[i]] >= cap:
            free &= np.array([s != sessions[i] for s in sessions])
    return taken


def mmr(candidates: DataFrame, k: int = 10, trade_off: float = 0.7, cap: int = 0) -> DataFrame:
    """candidates(query_id, id, relevance, score, session_id, embedding) to query_id, id, position, score, relevance.

    The candidates of one query are as few as the lists that were cut before, so one task holds them; they are taken in the
    order of relevance, then id, which decides ties. Rows without a vector are similar to nothing."""
    trade_off = trade_off if trade_off > 0 else 0.7
    kinds = dict(candidates.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["relevance", "id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        dims = max((len(v) for v in rows["embedding"] if v is not None), default=1)
        if any(v is not None and len(v) != dims for v in rows["embedding"]):
            raise ValueError("the vectors of a query's candidates have several lengths")
        vectors = np.array([v if v is not None else np.zeros(dims) for v in rows["embedding"]], np.float64)
        taken = select(rows["relevance"].to_numpy(), vectors @ vectors.T, rows["session_id"].tolist(), k, trade_off, cap)
        out = rows.loc[taken, ["query_id", "id", "score", "relevance"]].copy()
        out.insert(2, "position", np.arange(1, len(taken) + 1, dtype="int32"))
        return out

    rows = candidates.select("query_id", "id", "relevance", "score", "session_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.groupBy("query_id").applyInPandas(run, OUT.format(q=kinds["query_id"], i=kinds["id"]))
