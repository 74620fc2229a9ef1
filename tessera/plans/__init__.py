"""Grids and ranks that plans are built from."""
