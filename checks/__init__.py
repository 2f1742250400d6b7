"""Queries over the given tables and the same queries as plain SQL."""
