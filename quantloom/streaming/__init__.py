"""Structured Streaming twins of the live paths."""
