"""Structured Streaming forms of ingest, edit replay and progress counts."""
