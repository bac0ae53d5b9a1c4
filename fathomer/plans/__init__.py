"""Whole jobs made of operators: ingestion, tools and the query catalogue."""
