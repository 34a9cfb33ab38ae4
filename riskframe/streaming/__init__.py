"""Structured Streaming jobs (log monitoring re-aimed as streams)."""
