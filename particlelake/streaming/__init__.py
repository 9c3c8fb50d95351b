"""Structured Streaming ingestion and keyed refresh."""
