import json

import pytest
from pyspark.sql import functions as F

from lorekeep.__main__ import main
from lorekeep.config import Enrichment, from_environment
from lorekeep.operators import ledger as L


def test_settings_from_the_environment():
    env = {"LOREKEEP_VERSION": "3", "LOREKEEP_BACKOFF_SECONDS": "1.5", "LOREKEEP_MODEL": "m", "LOREKEEP_DIMS": "", "OTHER": "x"}
    got = from_environment(Enrichment, env)
    assert (got.version, got.backoff_seconds, got.model, got.dims) == (3, 1.5, "m", 768)
    with pytest.raises(ValueError):
        from_environment(Enrichment, {"LOREKEEP_VERSION": "three"})


def test_from_uploads_to_progress(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("LOREKEEP_DIMS", "4")
    (tmp_path / "turns").mkdir()
    turns = [{"conversation_id": f"c{i % 2}", "session_id": "s", "turn_id": f"t{i}", "speaker": "u", "text": f"text {i}", "date_time": "2023-05-02 10:15", "pos": i} for i in range(6)]
    (tmp_path / "turns" / "a.json").write_text("\n".join(map(json.dumps, turns + turns[:2])))
    ledger = f"file://{tmp_path}/ledger"
    main(["ingest", ledger, str(tmp_path / "turns")])
    main(["sweep", ledger])
    main(["progress", ledger])
    said = capsys.readouterr().out
    assert "6 memories" in said and "{'done': 6}" in said and "0 dead" in said
    assert "|c0             |3    |3   |0        |0   |" in said and "search_document" in said


def test_twins_report(spark):
    rows = lambda names: spark.createDataFrame([(n,) for n in names], "n string").select(F.sha2("n", 256).cast("binary").alias("content_hash"))
    n, some = L.twins_report(rows("abcdefgh"), rows("a"), 3)
    assert n == 7 and len(some) == 3 and some == sorted(some)
    assert L.twins_report(rows("a"), rows("a")) == (0, [])
