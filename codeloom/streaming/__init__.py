"""Incremental indexing and ledgers on Structured Streaming."""
