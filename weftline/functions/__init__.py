"""Scalar helpers: argument binding and glob patterns."""
