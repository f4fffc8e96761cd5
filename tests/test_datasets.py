import hashlib
import json
from functools import partial

import pytest
from pyspark.sql import functions as F

from lorekeep.config import Enrichment, Granularity, Mode, Search, tuning
from lorekeep.operators.embed import MockEmbedder
from lorekeep.operators.metrics import require_recall
from lorekeep.plans.evaluation import evaluate
from lorekeep.sources.datasets import find_file, gold_sessions, load

DIALOG = [
    ("m1", "s1", "nora", "My brother moved to Lisbon to open a bakery.", "2023-03-01 09:00"),
    ("m2", "s1", "eli", "Lovely, does he sell custard tarts there?", "2023-03-01 09:01"),
    ("m3", "s1", "nora", "Of course, and I am knitting a scarlet scarf for him.", "2023-03-01 09:03"),
    ("m4", "s1", "eli", "My telescope finally showed me Saturn's rings.", "2023-03-01 09:05"),
    ("m5", "s2", "eli", "I adopted a tortoise called Bolt from the rescue centre.", "2023-03-20 18:00"),
    ("m6", "s2", "nora", "A tortoise named Bolt, that is perfect irony.", "2023-03-20 18:02"),
    ("m7", "s2", "eli", "Work is calm, the insurance audit is over.", "2023-03-20 18:04"),
    ("m8", "s2", "nora", "I joined a choir that rehearses Verdi on Mondays.", "2023-03-20 18:06"),
    ("m9", "s3", "nora", "The kiln in my pottery studio exploded last night.", "2023-04-11 20:00"),
    ("m10", "s3", "eli", "Goodness, was anyone hurt by the blast?", "2023-04-11 20:01"),
    ("m11", "s3", "nora", "Nobody, only the glazed vases shattered.", "2023-04-11 20:02"),
    ("m12", "s3", "eli", "I will cycle across Patagonia in January.", "2023-04-11 20:05"),
]
QUESTIONS = [
    ("a1", "Where did the brother open his bakery?", ["m1"]),
    ("a2", "Which planet's rings did the telescope show?", ["m4"]),
    ("a3", "What is the adopted tortoise from the rescue centre called?", ["m5"]),
    ("a4", "Which composer does the choir rehearse?", ["m8"]),
    ("a5", "Who will cycle across Patagonia?", ["m12"]),
]


def put(folder, name, value):
    path = folder / name
    path.write_text(json.dumps(value))
    return str(path)


@pytest.fixture
def fixtures_file(tmp_path):
    turns = [dict(zip(("id", "session_id", "speaker", "text", "date_time"), t)) for t in DIALOG]
    questions = [{"id": i, "question": q, "evidence": e, "question_date": "2023-04-20"} for i, q, e in QUESTIONS]
    return put(tmp_path, "fixtures.json", {"turns": turns, "questions": questions})


@pytest.mark.parametrize("mode", [Mode.BM25, Mode.HYBRID])
def test_fixtures_from_file_to_report(spark, fixtures_file, mode):
    from dataclasses import replace

    how = tuning("fixtures")
    how = replace(how, search=replace(how.search, mode=mode))
    data = load(spark, "fixtures", fixtures_file)
    report = require_recall(evaluate(data, how, partial(MockEmbedder, 32), Enrichment(dims=32))) if mode == Mode.BM25 else evaluate(data, how, partial(MockEmbedder, 32), Enrichment(dims=32))
    rows = {r.grp: r for r in report.collect()}
    assert set(rows) == {None, "fixtures"} and rows[None].n == 5
    if mode == Mode.BM25:
        assert rows[None].recall_5 == 1.0


def test_the_gate_fails_below(spark):
    rows = spark.createDataFrame([(1, 0.9)], "overall int, recall_5 double")
    with pytest.raises(Exception, match="recall_5 is 0.9"):
        require_recall(rows).collect()


SAMPLE = {
    "sample_id": "dialog_k",
    "conversation": {
        "speaker_a": "A", "speaker_b": "B",
        "session_10_date_time": "7:42 am on 19 October, 2021", "session_10": [{"speaker": "A", "dia_id": "D10:1", "text": "later"}],
        "session_2_date_time": "3 February, 2020", "session_2": [{"speaker": "B", "dia_id": "D2:1", "text": "hi", "blip_caption": "a cat"}, {"speaker": "A", "dia_id": "D2:2", "text": "yo"}],
        "session_x": "no", "notes": [1],
    },
    "qa": [
        {"question": "q", "answer": 7, "category": 1, "evidence": [["D2:1"], ["D10:1", ["D2:2"]]]},
        {"question": "r", "answer": "s", "category": 5}, {"question": "t", "category": 2, "evidence": "D2:1"},
    ],
}


def test_locomo(spark, tmp_path):
    data = load(spark, "locomo", put(tmp_path, "locomo10.json", [SAMPLE]))
    rows = data.turns.orderBy("pos").collect()
    assert [(r.session_id, r.turn_id, r.date_time) for r in rows] == [("session_2", "D2:1", "3 February, 2020"), ("session_2", "D2:2", "3 February, 2020"), ("session_10", "D10:1", "7:42 am on 19 October, 2021")]
    asked = data.questions.orderBy("query_id").collect()
    assert [(r.query_id, r.evidence, r.grp) for r in asked] == [("dialog_k_q0", ["D2:1", "D10:1", "D2:2"], "category_1"), ("dialog_k_q1", [], "category_5"), ("dialog_k_q2", ["D2:1"], "category_2")]


def test_locomo_refuses(spark, tmp_path):
    bad = {**SAMPLE, "qa": [{"question": "q", "category": 1, "evidence": [42]}]}
    with pytest.raises(Exception, match="42"):
        load(spark, "locomo", put(tmp_path, "bad.json", [bad])).questions.collect()
    with pytest.raises(Exception, match="no array"):
        load(spark, "locomo", put(tmp_path, "object.json", SAMPLE)).turns.collect()


LONG = [
    {
        "question_id": "ask_red", "question_type": "multi", "question": "what?", "answer": 3, "question_date": "2021/11/04 (Thu) 16:35",
        "haystack_dates": ["2021/10/24 (Sun) 13:08"], "haystack_session_ids": ["walk", "cook"], "answer_session_ids": ["walk"],
        "haystack_sessions": [[{"role": "user", "content": "a"}, {"role": "assistant", "content": "b", "has_answer": True}], [{"role": "user", "content": "c", "has_answer": True}], [{"role": "user", "content": "dropped"}]],
    },
    {
        "question_id": "ask_blue_abs", "question_type": "single", "question": "who?", "question_date": "", "haystack_dates": [], "haystack_session_ids": ["rest"],
        "answer_session_ids": [], "haystack_sessions": [[{"role": "user", "content": "a", "has_answer": True}]],
    },
]


def test_longmemeval(spark, tmp_path):
    path = put(tmp_path, "longmemeval_s.json", LONG)
    data = load(spark, "longmemeval_s", path)
    first = data.questions.where("query_id = 'ask_red'").first()
    assert (first.evidence, first.grp) == (["walk_1", "cook_0"], "multi")
    assert data.questions.where("query_id = 'ask_blue_abs'").first().evidence is None
    rows = data.turns.where(F.col("conversation_id") == first.conversation_id).orderBy("pos").collect()
    assert [(r.turn_id, r.speaker, r.date_time) for r in rows] == [("walk_0", "user", "2021/10/24 (Sun) 13:08"), ("walk_1", "assistant", "2021/10/24 (Sun) 13:08"), ("cook_0", "user", "")]
    assert {r.query_id: r.sessions for r in gold_sessions(spark, path).collect()} == {"ask_red": ["walk"], "ask_blue_abs": None}


def test_names_and_defaults(tmp_path):
    with pytest.raises(ValueError):
        load(None, "unknown")
    with pytest.raises(FileNotFoundError):
        find_file(None, ["a.json"], str(tmp_path))
    put(tmp_path, "b.json", 1)
    assert find_file(None, ["a.json", "b.json"], str(tmp_path)).endswith("b.json") and find_file("x", []) == "x"
    how = Search(trade_off=-1, boost=0).resolved()
    assert (how.mode, how.top_k, how.candidates, how.rrf_k, how.trade_off, how.window_days, how.boost) == (Mode.HYBRID, 10, 100, 60, 0.7, 14.0, 1.3)
    assert tuning("locomo").search.rrf_k == 10 and tuning("longmemeval_s").granularity == Granularity.TURN and tuning("fixtures").search.max_per_session == 4
    with pytest.raises(ValueError):
        Search(mode="fuzzy").resolved()


@pytest.mark.parametrize("file_bytes", [4 << 20, 5000])
def test_sessions_share_files_of_fixtures(spark, tmp_path, monkeypatch, file_bytes):
    """The number of files goes by bytes, not by sessions; each session's turns are numbered from 0."""
    from lorekeep.queries import datasets as queries

    texts = ["x" * 100, None, '"\\\n\t{', ""]
    rows = [(c, t, "user" if t % 2 else None, texts[(c + t) % 4]) for c in range(40) for t in range(8) if c % 7 or t != 1]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    monkeypatch.setattr(queries, "new_folder", lambda _: f"file://{tmp_path}/out")
    monkeypatch.setattr(queries, "FILE_BYTES", file_bytes)
    got = {r.turn_id: (r.query_id, r.session_id, r.speaker, r.text_md5, r.pos) for r in queries.read_fixtures(spark, str(tmp_path)).collect()}
    size = sum(len(x or "") + 200 for *_, x in rows)
    files = [f for f in (tmp_path / "out").rglob("part-*") if f.is_file()]
    assert 1 <= len(files) <= -(-size // file_bytes) and (len(files) > 5) == (file_bytes == 5000)
    want = {}
    for c, t, role, text in rows:
        session = f"{c}_{t // 3}"
        want[f"{c}_{t}"] = (f"q{session}", session, role, None if text is None else hashlib.md5(text.encode()).hexdigest(), sum((a, b // 3) == (c, t // 3) and b < t for a, b, *_ in rows))
    assert got == want
