"""Structured Streaming jobs over landed snapshots."""
