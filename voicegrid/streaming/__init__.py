"""Structured Streaming jobs over review and event tables."""
