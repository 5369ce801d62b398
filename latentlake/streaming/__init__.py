"""Keyed state and write-once triggers on Structured Streaming."""
