"""Queries over the given tables, and the same queries in SQL."""
