"""Structured Streaming: change feeds, debounce and continuous ingestion."""
