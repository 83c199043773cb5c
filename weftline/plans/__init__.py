"""Declarative plans over listings of text objects."""
