"""Readers of grids and boundaries."""
