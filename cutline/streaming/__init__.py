"""Structured Streaming forms of the ledger and segment operators."""
