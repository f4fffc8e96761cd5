"""Ingest and enrichment as streams of what is there, and a view of throughput over event time."""
