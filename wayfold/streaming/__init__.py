"""Structured Streaming jobs for newly landed recordings."""
