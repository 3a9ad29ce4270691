"""Structured Streaming ingestion and standing queries."""
