"""Operators put together: search, evaluation and enrichment."""
