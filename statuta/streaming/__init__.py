"""Structured Streaming: incremental ingest, job states and event windows."""
