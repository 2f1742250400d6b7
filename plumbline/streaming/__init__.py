"""Incremental runs over a growing file tree."""
