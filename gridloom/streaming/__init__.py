"""Structured Streaming forms of the batch operators, and an incremental decoder."""
