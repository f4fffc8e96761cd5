"""Long-term conversational memory on Spark: an append-only ledger, text and vector enrichment, retrieval and its metrics."""
