import duckdb
import pytest

import __spark_entry__ as entry
from lorekeep import queries as own

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(own.QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def values(rows):
    return sorted(repr(tuple(None if x != x else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", ["tokenize_docs", "bm25_topn", "dense_topn", "rrf_k10", "mmr_session_cap", "evaluate_report", "granularity_round", "ledger_pending", "ledger_progress", "append_done", "ingest_dedup", "embed_outcomes"])
def test_against_sql(spark, name):
    """The driver holds all of them against their SQL on a larger table."""
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = own.QUERIES[name](spark, SF), db.sql(own.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    place = [want.columns.index(c) for c in columns]
    assert values(map(tuple, got.select(*columns).collect())) == values(tuple(r[i] for i in place) for r in want.fetchall())
