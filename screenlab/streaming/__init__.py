"""Streaming forms of mergeable aggregates (an extension)."""
