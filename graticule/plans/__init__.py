"""Whole pages: what each view of a dataset needs, as lazy DataFrames."""
