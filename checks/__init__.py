"""Queries over the given tables, with independent SQL for the same results."""
