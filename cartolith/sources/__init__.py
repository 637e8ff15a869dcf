"""Readers and writers for container files."""
