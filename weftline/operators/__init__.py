"""Mapping, reducing and statistics over calls."""
