"""Queries over the bundled tables."""
