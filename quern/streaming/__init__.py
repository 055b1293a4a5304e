"""Structured Streaming jobs over run logs and event tables."""
