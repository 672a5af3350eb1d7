"""Structured Streaming forms of the release arrival operators."""
