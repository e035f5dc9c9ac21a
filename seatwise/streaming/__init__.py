"""Incremental forms of the mergeable aggregates."""
