"""Structured Streaming: windows over a log, and idempotent ingestion."""
