import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.operators import bm25, metrics, mmr, ranking, rounds, temporal
from lorekeep.operators.dense import dense


def lists(spark, *ranked):
    rows = [[("q", i, k + 1) for k, i in enumerate(ids)] for ids in ranked]
    return [spark.createDataFrame(r, "query_id string, id string, rank int") for r in rows]


def test_rrf(spark):
    out = {r.id: r.score for r in ranking.rrf(lists(spark, ["x", "y", "d"], ["1", "2", "3", "4", "5", "6", "d"]), 60).collect()}
    assert out["d"] == pytest.approx(1 / 63 + 1 / 67) and out["x"] == pytest.approx(1 / 61) and len(out) == 9
    out = {r.id: r.score for r in ranking.rrf(lists(spark, ["a"], ["b", "a"]), 10).collect()}
    assert out == pytest.approx({"a": 1 / 11 + 1 / 12, "b": 1 / 11})


def corpus(spark, docs, conv="c"):
    return spark.createDataFrame([(conv, i, words.split()) for i, words in docs], "conversation_id string, id string, lexemes array<string>")


def asked(spark, words, conv="c", query="q"):
    return spark.createDataFrame([(query, conv, words.split())], "query_id string, conversation_id string, lexemes array<string>")


def test_bm25_matches_the_formula(spark):
    docs = [("d1", "a b c d"), ("d2", "a a c d"), ("d3", "e f g h"), ("d4", ""), ("d5", "a x")]
    got = {r.id: r.score for r in bm25.bm25(corpus(spark, docs), asked(spark, "a x a unknown")).collect()}
    n, avg = 5, sum(len(w.split()) for _, w in docs) / 5
    want = {}
    for i, w in docs:
        w = w.split()
        s = 0
        for t in ("a", "x", "a"):
            df = sum(t in v.split() for _, v in docs)
            tf = w.count(t)
            s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avg)) if tf else 0
        if s:
            want[i] = s
    assert got == pytest.approx(want, abs=1e-8)


def test_bm25_ranks_and_scope(spark):
    docs = corpus(spark, [("d1", "a b"), ("d2", "a a"), ("d3", "r b")]).unionByName(corpus(spark, [("z", "a a a")], "other"))
    assert [r.id for r in bm25.bm25(docs, asked(spark, "a"), 2).orderBy("rank").collect()] == ["d2", "d1"]
    assert bm25.bm25(docs, asked(spark, "nothing")).isEmpty()
    rare = {r.id: r.score for r in bm25.bm25(docs, asked(spark, "r b")).collect()}
    assert rare["d3"] > rare["d1"]


def test_dense(spark):
    rows = [("c", "d1", [1.0, 0.0]), ("c", "d2", [0.6, 0.8]), ("c", "d3", None), ("c", "d4", [-1.0, 0.0]), ("c", "d5", [1.0]), ("e", "d6", [1.0, 0.0])]
    docs = spark.createDataFrame(rows, "conversation_id string, id string, embedding array<float>")
    q = spark.createDataFrame([("q", "c", [1.0, 0.0]), ("w", "c", [1.0, 0.0, 0.0]), ("n", "c", None)], "query_id string, conversation_id string, embedding array<float>")
    got = [(r.query_id, r.id, r.score) for r in dense(docs, q, 10).orderBy("query_id", "rank").collect()]
    assert [x for x in got if x[0] == "q"] == [("q", "d1", 1.0), ("q", "d2", pytest.approx(0.6)), ("q", "d3", 0.0), ("q", "d4", -1.0)]
    assert {x[1:] for x in got if x[0] != "q"} <= {("d3", 0.0)}
    assert [r.id for r in dense(docs, q, 2, rows=1, asked=1).where("query_id = 'q'").orderBy("rank").collect()] == ["d1", "d2"]


def timed(spark):
    rows = [("q", "far", 1.05, "2023-01-01"), ("q", "near", 1.0, "2023-05-01"), ("q", "undated", 0.9, None), ("q", "edge", 0.1, "2023-05-16")]
    return spark.createDataFrame(rows, "query_id string, id string, score double, t string").select("query_id", "id", "score", F.col("t").cast("timestamp").alias("ts"), F.lit("2023-05-02").cast("timestamp").alias("query_time"))


def test_temporal(spark):
    soft = [(r.id, round(r.score, 6)) for r in temporal.temporal_adjust(timed(spark)).orderBy("rank").collect()]
    assert soft == [("near", 1.3), ("far", 1.05), ("undated", 0.9), ("edge", 0.13)]
    hard = temporal.temporal_adjust(timed(spark), 48 * 3600, hard=True)
    assert [r.id for r in hard.collect()] == ["near"]
    assert temporal.temporal_adjust(timed(spark), 60, hard=True).count() == 4
    no_time = timed(spark).withColumn("query_time", F.lit(None).cast("timestamp"))
    assert [r.score for r in temporal.temporal_adjust(no_time).orderBy("rank").collect()] == [1.05, 1.0, 0.9, 0.1]


def test_mmr_select():
    sim = np.array([[1, 0.95, 0.1], [0.95, 1, 0.1], [0.1, 0.1, 1]])
    assert mmr.select(np.array([0.9, 0.89, 0.85]), sim, ["a", "b", "c"], 3, 0.7, 0) == [0, 2, 1]
    assert mmr.select(np.linspace(1, 0.1, 10), np.zeros((10, 10)), ["s"] * 10, 10, 0.7, 2) == [0, 1]
    assert mmr.select(np.array([0.9, 0.8, 0.7, 0.6, 0.5]), np.zeros((5, 5)), list("aaabb"), 5, 0.7, 2) == [0, 1, 3, 4]
    assert mmr.select(np.array([1.0, 1.0]), np.zeros((2, 2)), [1, 2], 0, 0.7, 0) == [0, 1]


def test_mmr_on_rows(spark):
    rows = [("q", "b", 0.89, 2.0, "s", [0.95, 0.31]), ("q", "a", 0.9, 3.0, "s", [1.0, 0.0]), ("q", "c", 0.85, 1.0, "s", None)]
    df = spark.createDataFrame(rows, "query_id string, id string, relevance double, score double, session_id string, embedding array<float>")
    assert [(r.id, r.score) for r in mmr.mmr(df, 3).orderBy("position").collect()] == [("a", 3.0), ("c", 1.0), ("b", 2.0)]


def turns(spark, rows):
    return spark.createDataFrame([("c", s, f"t{i + 1}", who, f"x{i + 1}", "d", i) for i, (s, who) in enumerate(rows)], "conversation_id string, session_id string, turn_id string, speaker string, text string, date_time string, pos int")


def greedy(rows):
    out, open_ = [], None
    for i, (s, who) in enumerate(rows):
        if open_ and len(open_[1]) < 2 and open_[0] == s and open_[2] != who:
            open_[1].append(f"t{i + 1}")
        else:
            open_ = (s, [f"t{i + 1}"], who)
            out.append(open_[1])
    return sorted(out)


def test_rounds(spark):
    given = [("s", "a"), ("s", "b"), ("s", "b"), ("s", "a"), ("s", "b")]
    assert sorted(r.turn_ids for r in rounds.rounds(turns(spark, given)).collect()) == [["t1", "t2"], ["t3", "t4"], ["t5"]] == greedy(given)
    first = rounds.rounds(turns(spark, given)).where("round_no = 0").first()
    assert (first.round_id, first.text) == ("s:round:0", "a: x1\nb: x2")
    rnd = random.Random(5)
    for _ in range(4):
        some = [(rnd.choice("st"), rnd.choice("abc")) for _ in range(40)]
        assert sorted(r.turn_ids for r in rounds.rounds(turns(spark, some)).collect()) == greedy(some)


def test_granularity(spark):
    rows = turns(spark, [("s", "a"), ("s", "b"), ("s", "b")])
    alone = rows.select("conversation_id", F.col("turn_id").alias("id")).withColumn("members", F.lit(None).cast("array<string>"))
    items = alone.unionByName(rounds.round_items(rows).select("conversation_id", "id", "members"))
    ids = lambda g: sorted(r.id for r in rounds.at_granularity(items, g).collect())
    assert ids("turn") == ["t1", "t2", "t3"] and ids("round") == ["t1+t2", "t3"] and ids("all") == ["t1", "t1+t2", "t2", "t3"]
    with pytest.raises(ValueError):
        rounds.at_granularity(items, "word")
    out = spark.range(1).select(rounds.expanded(F.array(F.lit("t2"), F.lit("t1+t2"), F.lit("t3")), F.array(F.lit(None).cast("array<string>"), F.array(F.lit("t1"), F.lit("t2")), F.lit(None).cast("array<string>"))).alias("x"))
    assert out.first().x == ["t2", "t1", "t3"]


def test_metrics(spark):
    df = spark.createDataFrame([(list("abcde"), ["b", "e"]), (["b", "b", "e"], ["b", "e"]), (["x"], ["b"]), (["b"], [])], "r array<string>, g array<string>")
    r, g = F.col("r"), F.col("g")
    rows = df.select(metrics.recall(r, g, 1), metrics.recall(r, g, 3), metrics.recall(r, g, 5), metrics.reciprocal_rank(r, g), metrics.ndcg(r, g, 5), metrics.ndcg(r, g, 2), metrics.recall(r, g)).collect()
    ideal = 1 + 1 / math.log2(3)
    assert list(rows[0]) == pytest.approx([0, 0.5, 1, 0.5, (1 / math.log2(3) + 1 / math.log2(6)) / ideal, (1 / math.log2(3)) / ideal, 1])
    assert rows[1][4] == pytest.approx((1 + 1 / math.log2(4)) / ideal) and list(rows[2]) == [0] * 7 and list(rows[3]) == [0] * 7


def test_evaluate(spark):
    rows = [("q1", "g", ["a"], ["a"]), ("q2", "g", ["x", "b"], ["b"]), ("q3", "none", ["x"], [])]
    out = {r.grp: r for r in metrics.evaluate(spark.createDataFrame(rows, "query_id string, grp string, retrieved array<string>, gold array<string>"), (1, 2)).collect()}
    assert set(out) == {None, "g"} and (out[None].n, out[None].skipped) == (2, 1)
    assert out[None].recall_1 == 0.5 and out[None].mrr == 0.75 and out["g"].recall_2 == 1


def test_report_of_hits(spark):
    rows = [("g", [1, 3], 2), ("g", [], 5), ("h", [2], 1_000_000_000), ("h", [], 0), ("n", [], None)]
    out = {r.grp: r for r in metrics.report(spark.createDataFrame(rows, "grp string, hits array<int>, wanted long"), (1, 2)).collect()}
    assert set(out) == {None, "g", "h"}
    assert (out[None].n, out[None].skipped, out["h"].skipped) == (3, 2, 1)
    assert out["g"].recall_1 == pytest.approx(0.25) and out["g"].mrr == pytest.approx(0.5)
    assert out["h"].recall_2 == pytest.approx(1e-9) and out["h"].ndcg_2 == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))
