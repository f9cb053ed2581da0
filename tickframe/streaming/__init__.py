"""Structured Streaming forms of the session summary."""
