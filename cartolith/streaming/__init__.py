"""Structured Streaming over arriving files and events."""
