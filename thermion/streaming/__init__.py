"""Structured Streaming forms of sessions, windows and re-scoring."""
