"""The operators on the driver's tables, by name, and the SQL that each is held against."""

from . import datasets, enrichment, ledger, retrieval, rounds, streams, text

_PARTS = (text, retrieval, rounds, ledger, enrichment, streams, datasets)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
