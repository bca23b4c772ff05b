"""Streaming forms of ingest and event detection."""
