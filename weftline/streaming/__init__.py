"""Counters and last-write-wins dictionaries as Structured Streaming state."""
